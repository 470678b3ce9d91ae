"""The registry of queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.functions import arrays as A
from bookloom.functions import text as T
from bookloom.operators import chapters as C
from bookloom.operators import documents as D
from bookloom.operators import segments as S
from bookloom.operators.tables import once, running, table
from bookloom.sources import sinks
from bookloom.streaming import jobs as J

# Words that are no keywords.
STOPWORDS = "và là của để có không trong một đã được người với cho những này khi thì mà nhưng cũng như lại còn về ra vào lên xuống".split()

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").where("text is not null")


WS = T.WS
TRIM = f"'^{WS}+|{WS}+$', '', 'g'"
PARAGRAPHS = "(SELECT DISTINCT ON (paragraph_id) * FROM paragraphs)"
SEGMENTS = "(SELECT DISTINCT ON (segment_id) * FROM tts_segments)"
TIMINGS = "(SELECT DISTINCT ON (segment_id, attempt) * FROM segment_timings)"
SEGMENT_LIST = f"""CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, '{T.TTS_SENTENCE.replace("'", "''")}'), lambda s: regexp_replace(s, {TRIM})), lambda s: s <> '')) > 0
  THEN list_filter(list_transform(regexp_extract_all(text, '{T.TTS_SENTENCE.replace("'", "''")}'), lambda s: regexp_replace(s, {TRIM})), lambda s: s <> '')
  WHEN regexp_replace(text, {TRIM}) <> '' THEN [regexp_replace(text, {TRIM})] ELSE [] END"""
LINES = f"""SELECT doc_id, CAST(unnest(generate_series(0, len(p) - 1)) AS INTEGER) AS line_no, unnest(p) AS raw
  FROM (SELECT doc_id, string_split_regex(text, '{T.LINE_BREAK}') AS p FROM documents WHERE text IS NOT NULL)"""


def normal(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, 'Ƣƣ', 'Ưư'), '{WS}+', ' ', 'g'), ' ')"



@query(f"SELECT doc_id, line_no, {normal('raw')} AS line FROM ({LINES}) WHERE {normal('raw')} <> ''")
def doc_lines(spark, d):
    return D.document_lines(docs(spark, d))


@query(f"SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS segment_no, unnest(s) AS segment FROM (SELECT doc_id, {SEGMENT_LIST} AS s FROM documents WHERE text IS NOT NULL) WHERE len(s) > 0")
def tts_segments(spark, d):
    return S.numbered_segments(docs(spark, d), "doc_id")


@query(f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(text, '{T.NON_WS}+')) AS BIGINT) AS n_words, CAST(len({SEGMENT_LIST}) AS BIGINT) AS n_segments
 FROM documents WHERE text IS NOT NULL""")
def doc_stats(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.length(t).cast("long").alias("n_chars"), T.word_count(t).cast("long").alias("n_words"), F.size(T.speech_segments(t)).cast("long").alias("n_segments"))


def _clean_sql() -> str:
    out = "text"
    for p, to in T.CLEAN_STEPS:
        sql_p, sql_to = p.replace("'", "''"), to.replace("$1", "\\1")
        out = f"regexp_replace({out}, '{sql_p}', '{sql_to}', 'g')"
    out = f"translate({out}, '{T.SPEECH_FROM}', '{T.SPEECH_TO.replace(chr(39), chr(39) * 2)}')"
    for a, b in T.SPEECH_WORDS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({out}, '{T.SPEECH_DROP}', '', 'g'), {TRIM})"


@query(f"SELECT doc_id, {_clean_sql()} AS text FROM documents WHERE text IS NOT NULL")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


def _noise_sql(c: str) -> str:
    also = {"domain": f" AND (len(regexp_extract_all({c}, '{T.NON_WS}+')) <= 12 OR regexp_matches({c}, '[/@]'))", "contents": f" AND length({c}) < 30"}
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}'){also.get(n, '')} THEN '{n}'" for n, p in T.NOISE_RULES) + " END"


@query(f"""SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {_noise_sql('line')} AS rule FROM
 (SELECT doc_id, {normal('raw')} AS line FROM ({LINES})) WHERE line <> '') WHERE rule IS NOT NULL GROUP BY rule""")
def noise_audit(spark, d):
    ruled = D.document_lines(docs(spark, d)).select("doc_id", T.noise_rule(F.col("line")).alias("rule")).where("rule is not null")
    return ruled.groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


KEY_SQL = rf"substring(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '{WS}+', ' ', 'g'), '^[ –—_|•·-]+|[ –—_|•·-]+$', '', 'g'), 1, 120)"


@query(f"""SELECT book_id, key, count(*) AS n FROM (SELECT book_id, {KEY_SQL} AS key FROM (
   SELECT book_id, unnest(lines) AS line FROM (SELECT DISTINCT ON (page_id) * FROM source_pages)))
 WHERE key <> '' GROUP BY book_id, key HAVING count(*) >= 3 AND len(regexp_extract_all(key, '{T.NON_WS}+')) <= 14""")
def repeated_lines(spark, d):
    pages = once(table(spark, d, "source_pages").select("page_id", "book_id", "lines"), "page_id")
    return D.repeated_lines(pages.select("book_id", F.explode("lines").alias("line")))


def _contents_sql() -> str:
    x = f"list_transform(coalesce(lines, []), lambda s: {normal('s')})"
    many = lambda p: f"len(list_filter({x}, lambda s: regexp_matches(s, '{p}')))"
    parts = {"leaders": many(r"\.{4,} *[0-9]+"), "chapters": many("(?i)^(?:Chương|Chapter) +"), "numbered": many("^[0-9]{1,2} +[^ ]+"), "bare": many("^[0-9]{1,2}$"), "parts": many("(?i)^(?:PHẦN +(?:THỨ +.+|[0-9]{1,2})|PART +[0-9]{1,2})$"), "titled": many("(?i)^(?:mục lục|table of contents)$")}
    inner = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    return f"""SELECT page_id, CAST(leaders AS INTEGER) AS leaders, CAST(numbered AS INTEGER) AS numbered,
  titled > 0 OR leaders >= 2 OR chapters >= 4 OR numbered >= 4 OR (bare >= 4 AND parts >= 1) OR parts >= 3 AS is_contents
  FROM (SELECT page_id, {inner} FROM (SELECT DISTINCT ON (page_id) * FROM source_pages))"""


@query(_contents_sql())
def contents_pages(spark, d):
    return D.contents_pages(once(table(spark, d, "source_pages").select("page_id", "lines"), "page_id"))


@query()
def chapter_detect(spark, d):
    return C.detect_chapters(once(table(spark, d, "source_pages").select("page_id", "book_id", "page_number", "lines"), "page_id"))


@query()
def merge_body_blocks(spark, d):
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "book_id", "chapter_index", "paragraph_index", "text"), "paragraph_id")
    blocks = p.select("book_id", "chapter_index", F.col("paragraph_index").alias("block_no"), T.clean_text(F.col("text")).alias("text"), F.lit(False).alias("is_heading"))
    return C.merged_blocks(blocks)


HEAD = r"(?i)^(?:chương|chapter|kapitel|chapitre|capítulo|глава|phần) *[0-9]+"


@query(f"""SELECT book_id, heading_no, count(*) AS n_blocks, min(chapter_index) AS first_chapter FROM (
  SELECT book_id, chapter_index, CAST(sum(CASE WHEN regexp_matches(chapter_title, '{HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY chapter_index, chapter_id) AS BIGINT) AS heading_no
  FROM (SELECT DISTINCT ON (chapter_id) * FROM chapters)) GROUP BY book_id, heading_no""")
def chapters_by_heading(spark, d):
    """Chapters grouped under numbered headings: islands by a running count of headings."""
    c = once(table(spark, d, "chapters").select("chapter_id", "book_id", "chapter_index", "chapter_title"), "chapter_id")
    c = c.withColumn("heading", F.when(F.col("chapter_title").rlike(HEAD.replace("(?i)", "(?iu)")), 1).otherwise(0))
    islands = running(c, ["book_id"], ["chapter_index", "chapter_id"], heading_no=("heading", "sum"))
    return islands.groupBy("book_id", "heading_no").agg(F.count("*").alias("n_blocks"), F.min("chapter_index").alias("first_chapter"))


SENTENCES_SQL = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？]){WS}+', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: regexp_replace(s, {TRIM})), lambda s: s <> '')"


@query(f"SELECT paragraph_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM (SELECT paragraph_id, {SENTENCES_SQL} AS s FROM {PARAGRAPHS} WHERE text IS NOT NULL) WHERE len(s) > 0")
def sentence_split(spark, d):
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "text").where("text is not null"), "paragraph_id")
    return p.select("paragraph_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query(f"""SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank
 FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL))
 WHERE regexp_full_match(word, '[a-zà-ỹ_]+') AND length(word) > 2 AND word NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) GROUP BY doc_id, word) WHERE rank <= 10""")
def keywords_top10(spark, d):
    return D.keywords(docs(spark, d), "doc_id", STOPWORDS)


@query()
def entities_top5(spark, d):
    return D.entities(docs(spark, d), "doc_id")


def share(keep: str) -> str:
    return f"(length(h) - length(regexp_replace(h, '[{keep}]', '', 'g')))::DOUBLE / length(h)"


@query(f"""SELECT doc_id, CASE WHEN regexp_replace(h, '{WS}+', '', 'g') = '' THEN 'unknown' WHEN {share(T.VIETNAMESE)} >= 0.015 THEN 'vi' WHEN {share('一-鿿')} > 0.1 THEN 'zh' ELSE 'en' END AS detected
 FROM (SELECT doc_id, substring(text, 1, 5000) AS h FROM documents WHERE text IS NOT NULL)""")
def language_detect(spark, d):
    return docs(spark, d).select("doc_id", T.language(F.col("text")).alias("detected"))


@query(f"SELECT doc_id, array_to_string(list_filter({SENTENCES_SQL}, lambda s: length(s) > 15)[1:3], ' ') AS summary FROM documents WHERE text IS NOT NULL")
def extractive_summary(spark, d):
    lead = F.slice(F.filter(T.sentences(F.col("text")), lambda s: F.length(s) > 15), 1, 3)
    return docs(spark, d).select("doc_id", F.array_join(lead, " ").alias("summary"))


@query(f"""SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, array_to_string(w[k * 700 + 1 : k * 700 + 700], ' ') AS chunk FROM (
 SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0) // 700)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{T.NON_WS}+') AS w FROM documents WHERE text IS NOT NULL))""")
def word_chunks_700(spark, d):
    w = docs(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(f"{T.NON_WS}+"), F.lit(0)).alias("w"))
    each = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - 1, F.lit(0)) / 700).cast("int"))).alias("chunk_no"))
    return each.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * 700 + 1, 700), " ").alias("chunk"))


@query(f"""SELECT lang, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '{T.DIALOGUE.replace("'", "''")}') THEN 1 ELSE 0 END) AS BIGINT) AS n_dialogue,
 round(avg(CASE WHEN regexp_matches(text, '{T.DIALOGUE.replace("'", "''")}') THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM {SEGMENTS} WHERE text IS NOT NULL GROUP BY lang""")
def dialogue_ratio(spark, d):
    s = once(table(spark, d, "tts_segments").select("segment_id", "lang", "text").where("text is not null"), "segment_id")
    flag = T.is_dialogue(F.col("text")).cast("int")
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.sum(flag).alias("n_dialogue"), F.round(F.avg(flag.cast("double")), 6).alias("ratio"))


@query(f"""SELECT book_id, arg_max(emotion, (n, -first_pos)) AS mood, max(n) AS n FROM (SELECT book_id, emotion, count(*) AS n, min(segment_index) AS first_pos
 FROM {SEGMENTS} WHERE emotion IS NOT NULL GROUP BY book_id, emotion) GROUP BY book_id""")
def majority_mood(spark, d):
    """The most frequent emotion of a book, ties to the one met first."""
    s = once(table(spark, d, "tts_segments").select("segment_id", "book_id", "segment_index", "emotion").where("emotion is not null"), "segment_id")
    each = s.groupBy("book_id", "emotion").agg(F.count("*").alias("n"), F.min("segment_index").alias("first_pos"))
    return each.groupBy("book_id").agg(F.max_by("emotion", F.struct("n", -F.col("first_pos"))).alias("mood"), F.max("n").alias("n"))


@query("""SELECT e.vec_id, arg_max(c.label, (s, -c.label)) AS label, round(max(s), 6) AS score FROM (
  SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS s FROM embeddings e, (
    SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) c) t
 JOIN embeddings e USING (vec_id) JOIN (SELECT DISTINCT label FROM embeddings) c ON c.label = t.label GROUP BY e.vec_id""")
def semantic_label(spark, d):
    """Each vector's nearest label by cosine to the labels' mean vectors.

    Vectors meet the labels coordinate by coordinate in a join, and products are summed up by (vector, label): no table
    of labels is sent anywhere as a whole, so there may be as many as one likes.
    """
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    unit = means.join(norms, "label").select(F.col("label").alias("other"), "i", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0).alias("m"))
    points = e.select("vec_id", F.sqrt(A.dot(F.col("embedding"), F.col("embedding"))).alias("size"), F.posexplode("embedding").alias("i", "x"))
    each = points.join(unit, "i").select("vec_id", "size", "other", (F.col("m") * F.col("x")).alias("p"))
    scored = each.groupBy("vec_id", "other").agg((F.sum("p") / F.max("size")).alias("s"))
    best = F.max(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), (-F.col("other")).alias("l")))
    return scored.groupBy("vec_id").agg(best.alias("b")).select("vec_id", (-F.col("b.l")).alias("label"), F.round("b.s", 6).alias("score"))


@query("SELECT voice_id, other, round(s, 6) AS score FROM (SELECT a.voice_id, b.voice_id AS other, list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY a.voice_id ORDER BY list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) DESC, b.voice_id) AS r FROM voices a JOIN voices b ON a.voice_id <> b.voice_id) WHERE r = 1")
def nearest_voice(spark, d):
    """The voice most like each voice; the catalogue is a fixed table of a few rows."""
    v = table(spark, d, "voices").select("voice_id", "vector")
    every = v.agg(F.collect_list(F.struct(F.col("voice_id").alias("other"), "vector")).alias("all")).withColumn("one", F.lit(1))
    pairs = v.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("voice_id", "vector", F.explode("all").alias("o")).where("o.other <> voice_id")
    scored = pairs.select("voice_id", F.col("o.other").alias("other"), A.cosine(F.col("vector"), F.col("o.vector")).alias("s"))
    rank = Window.partitionBy("voice_id").orderBy(F.desc("s"), "other")
    return scored.withColumn("r", F.row_number().over(rank)).where("r = 1").select("voice_id", "other", F.round("s", 6).alias("score"))


@query("SELECT user_id, CAST(CAST('0x' || right(sha256(lower(CAST(user_id AS VARCHAR))), 8) AS BIGINT) % 8 AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY user_id")
def hash_assign(spark, d):
    """A stable choice of eight by SHA-256 of the name."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", A.hash_choice(F.col("user_id").cast("string"), 8).alias("bucket"), "n")


@query(f"""SELECT segment_id, floor(100 * (CASE lower(coalesce(emotion, 'neutral')) WHEN 'angry' THEN 1 + 0.5::DOUBLE * i WHEN 'sad' THEN 1 - 0.3::DOUBLE * i WHEN 'happy' THEN 1 + 0.4::DOUBLE * i ELSE 1.0::DOUBLE END) + 0.5) / 100 AS speed,
 floor(100 * (CASE lower(coalesce(emotion, 'neutral')) WHEN 'angry' THEN 1 + 0.5::DOUBLE * i WHEN 'sad' THEN 1 - 0.3::DOUBLE * i ELSE 1.0::DOUBLE END) + 0.5) / 100 AS pitch FROM (SELECT *, coalesce(intensity, 1.0) AS i FROM {SEGMENTS})""")
def prosody(spark, d):
    s = once(table(spark, d, "tts_segments").select("segment_id", "emotion", "intensity"), "segment_id")
    return s.select("segment_id", A.prosody(F.col("emotion"), F.col("intensity")).alias("p")).select("segment_id", "p.speed", "p.pitch")


@query(f"""SELECT s.segment_id, coalesce(c.emotion, 'neutral') AS emotion FROM {SEGMENTS} s LEFT JOIN (
 SELECT text, arg_max(emotion, segment_id) AS emotion FROM {SEGMENTS} WHERE emotion IS NOT NULL AND text IS NOT NULL GROUP BY text) c ON c.text = s.text""")
def segment_class_join(spark, d):
    """Each segment with the class that its text got last; texts meet by their hash, not by themselves."""
    s = once(table(spark, d, "tts_segments").select("segment_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "emotion"), "segment_id")
    told = s.where("emotion is not null and key is not null").groupBy("key").agg(F.max_by("emotion", "segment_id").alias("told"))
    return s.select("segment_id", "key").join(told, "key", "left").select("segment_id", F.coalesce("told", F.lit("neutral")).alias("emotion"))


BEST_TIMING = f"(SELECT segment_id, max(CASE WHEN audio_duration_seconds > 0 THEN audio_duration_seconds END) AS seconds FROM {TIMINGS} GROUP BY segment_id)"


def _timed(spark, d):
    t = once(table(spark, d, "segment_timings").select("segment_id", "attempt", "audio_duration_seconds"), "segment_id", "attempt")
    best = t.groupBy("segment_id").agg(F.max(F.when(F.col("audio_duration_seconds") > 0, F.col("audio_duration_seconds"))).alias("seconds"))
    s = once(table(spark, d, "tts_segments").select("segment_id", "book_id", "chapter_index", "segment_index"), "segment_id")
    return s.join(best, "segment_id", "left").withColumnRenamed("segment_index", "segment_no")


@query(f"""SELECT book_id, chapter_index, round(min(e - x), 3) AS start_s, round(max(e), 3) AS end_s, count(*) AS n_segments FROM (
  SELECT *, sum(x) OVER (PARTITION BY book_id ORDER BY chapter_index, segment_index, segment_id ROWS UNBOUNDED PRECEDING) AS e FROM (
   SELECT s.*, greatest(coalesce(b.seconds, 0), 0) AS x FROM {SEGMENTS} s LEFT JOIN {BEST_TIMING} b USING (segment_id))) GROUP BY book_id, chapter_index""")
def chapter_markers(spark, d):
    return S.chapter_markers(_timed(spark, d).withColumn("segment_no", F.struct("segment_no", "segment_id")))


@query(f"SELECT book_id, count(*) AS n, round(avg(rtf), 6) AS avg_rtf, max(rtf) AS max_rtf, arg_max(segment_id, (rtf, -segment_id, -attempt)) AS slowest_segment, arg_max(attempt, (rtf, -segment_id, -attempt)) AS slowest_attempt FROM {TIMINGS} WHERE rtf IS NOT NULL GROUP BY book_id")
def rtf_summary(spark, d):
    t = once(table(spark, d, "segment_timings").select("segment_id", "attempt", "book_id", "rtf"), "segment_id", "attempt")
    return S.rtf_summary(t, "book_id")


@query(f"""SELECT book_id, chapter_index, count(*) AS n_attempts, count(DISTINCT segment_id) AS n_segments, CAST(sum(text_chars) AS BIGINT) AS chars,
 round(sum(audio_duration_seconds), 3) AS audio_s, round(sum(tts_wall_seconds), 3) AS wall_s, CAST(sum(CASE WHEN audio_duration_seconds > 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_failed FROM {TIMINGS} GROUP BY book_id, chapter_index""")
def chapter_timing_stats(spark, d):
    t = once(table(spark, d, "segment_timings").drop("ingested_at"), "segment_id", "attempt")
    return t.groupBy("book_id", "chapter_index").agg(
        F.count("*").alias("n_attempts"), F.countDistinct("segment_id").alias("n_segments"), F.sum("text_chars").alias("chars"),
        F.round(F.sum("audio_duration_seconds"), 3).alias("audio_s"), F.round(F.sum("tts_wall_seconds"), 3).alias("wall_s"),
        F.sum(F.when(F.col("audio_duration_seconds") > 0, 0).otherwise(1)).alias("n_failed"),
    )


@query(f"SELECT book_id, chapter_index, count(*) AS n_missing, min(segment_id) AS first_missing FROM {SEGMENTS} s WHERE NOT EXISTS (SELECT 1 FROM segment_timings t WHERE t.segment_id = s.segment_id AND t.audio_duration_seconds > 0) GROUP BY book_id, chapter_index")
def missing_segments(spark, d):
    s = once(table(spark, d, "tts_segments").select("segment_id", "book_id", "chapter_index"), "segment_id")
    return S.missing_segments(s, table(spark, d, "segment_timings"))


@query(f"""SELECT book_id, n_segments, n_retry, round(1 - n_retry / n_segments, 6) AS score, 1 - n_retry / n_segments >= 0.8 AS passed FROM (
 SELECT book_id, count(*) AS n_segments, CAST(sum(CASE WHEN b.seconds > 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_retry FROM {SEGMENTS} s LEFT JOIN {BEST_TIMING} b USING (segment_id) GROUP BY book_id)""")
def quality(spark, d):
    s = once(table(spark, d, "tts_segments").select("segment_id", "book_id"), "segment_id")
    t = table(spark, d, "segment_timings").select("segment_id", "audio_duration_seconds")
    return S.quality(s, t)


@query("SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) s(status) LEFT JOIN (SELECT status, count(*) AS n FROM (SELECT DISTINCT ON (job_id) * FROM jobs) GROUP BY status) j ON j.status = s.status")
def job_counts(spark, d):
    """Jobs of each state, with zeros for states without any."""
    domain = spark.createDataFrame([(s,) for s in ("pending", "running", "completed", "failed", "cancelled")], "status string")
    n = once(table(spark, d, "jobs").select("job_id", "status"), "job_id").groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT book_id, count(*) AS n_jobs, arg_max(job_id, (created_at, job_id)) AS last_job, arg_max(status, (created_at, job_id)) AS last_status FROM (SELECT DISTINCT ON (job_id) * FROM jobs) GROUP BY book_id")
def latest_job(spark, d):
    j = once(table(spark, d, "jobs").select("job_id", "book_id", "status", "created_at"), "job_id")
    last = F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id"))
    return j.groupBy("book_id").agg(F.count("*").alias("n_jobs"), last["job_id"].alias("last_job"), last["status"].alias("last_status"))


@query("""SELECT event_id, user_id, round(max(p) OVER w, 6) AS progress, count(z) OVER w AS n_values FROM (SELECT event_id, user_id, ts, least(1.0, greatest(0.0, value / 100)) AS p, nullif(value, 0) AS z FROM events)
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def progress_monotone(spark, d):
    """Progress that never falls back, along each user's events."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("p"), F.nullif("value", F.lit(0.0)).alias("z"))
    out = running(e, ["user_id"], ["ts", "event_id"], progress=("p", "max"), n_values=("z", "count"))
    return out.select("event_id", "user_id", F.round("progress", 6).alias("progress"), "n_values")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN regexp_matches(text, '[0-9]') THEN 'digit' WHEN regexp_matches(text, '(?:[a-zA-Z]\\.){2,}|[A-Z]{2,}') THEN 'acronym'
 WHEN NOT regexp_matches(text, '[.,?!]$') THEN 'end' WHEN s IS NULL OR s < 3 THEN 'short' WHEN s > 15 THEN 'long' ELSE 'ok' END AS reason FROM (SELECT g.text, b.seconds AS s FROM """ + SEGMENTS + " g LEFT JOIN " + BEST_TIMING + " b USING (segment_id))) GROUP BY reason")
def training_filter_reasons(spark, d):
    """Speech-training samples by the first reason against them."""
    s = once(table(spark, d, "tts_segments").select("segment_id", "text"), "segment_id")
    t = table(spark, d, "segment_timings").groupBy("segment_id").agg(F.max(F.when(F.col("audio_duration_seconds") > 0, F.col("audio_duration_seconds"))).alias("s"))
    return s.join(t, "segment_id", "left").groupBy(T.training_reason(F.col("text"), F.col("s")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT part, kind, count(*) AS n FROM (SELECT 'document' AS kind, CASE WHEN right(md5(CAST(doc_id AS VARCHAR)), 2) < '0d' THEN 'eval' ELSE 'train' END AS part FROM documents UNION ALL SELECT 'segment', CASE WHEN right(md5(CAST(segment_id AS VARCHAR)), 2) < '0d' THEN 'eval' ELSE 'train' END FROM " + SEGMENTS + ") GROUP BY part, kind")
def split_by_hash(spark, d):
    """A fixed split of two united sources, about a twentieth for evaluation."""
    a = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    b = once(table(spark, d, "tts_segments").select("segment_id"), "segment_id").select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"))
    part = F.when(F.right(F.md5(F.col("id").cast("string").cast("binary")), F.lit(2)) < "0d", "eval").otherwise("train")
    return a.unionByName(b).groupBy(part.alias("part"), "kind").agg(F.count("*").alias("n"))


@query()
def codes_pad_mask(spark, d):
    """Token ids from vectors: valid, padded to 80 and masked before the first 10."""
    ids = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(x * 100), F.lit(64)).cast("int")).alias("ids"))
    return ids.select("vec_id", A.valid_codes(F.col("ids")).alias("valid"), A.padded(F.col("ids"), 80).alias("padded"), A.label_mask(F.col("ids"), 10).alias("labels"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) AS rms, round(list_max(list_transform(v, lambda x: greatest(-1.0, least(1.0, x * 0.1 / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v)))))), 6) AS peak
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def signal_normalise(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.round(A.rms(F.col("embedding")), 6).alias("rms"), F.round(F.array_max(A.normalise(F.col("embedding"))), 6).alias("peak"))


@query()
def signal_fade_pause(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", A.with_silence(A.fade(F.col("embedding"), 10), F.lit(4)).alias("samples"))
    return e.select("vec_id", F.size("samples").alias("n"), F.round(A.rms(F.col("samples")), 6).alias("rms"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents WHERE title IS NOT NULL""")
def escape_titles(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", T.escape_html(F.col("title")).alias("escaped"))


@query()
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query(f"""SELECT doc_id, array_to_string(list_concat(list_concat(['<speak>'], list_transform({SENTENCES_SQL}, lambda s: '<s>' || replace(replace(replace(replace(replace(regexp_replace(s, '\\.$', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</s><break time="0.5s"/>')), ['</speak>']), chr(10)) AS ssml
 FROM documents WHERE text IS NOT NULL""")
def ssml_render(spark, d):
    return docs(spark, d).select("doc_id", sinks.ssml(F.lit(None).cast("string"), T.sentences(F.col("text"))).alias("ssml"))


@query(f"""SELECT segment_id, CAST(CASE WHEN ends_with(t, '...') THEN 600 WHEN ends_with(t, '.') THEN 500 WHEN ends_with(t, ',') THEN 300 WHEN regexp_matches(t, '[!?]$') THEN 700 WHEN regexp_matches(t, '[;:]$') THEN 400 ELSE 200 END AS INTEGER) AS pause
 FROM (SELECT segment_id, regexp_replace(text, '{WS}+$', '') AS t FROM {SEGMENTS} WHERE text IS NOT NULL)""")
def pauses(spark, d):
    s = once(table(spark, d, "tts_segments").select("segment_id", "text").where("text is not null"), "segment_id")
    return s.select("segment_id", T.pause_ms(F.col("text")).alias("pause"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, max(value) AS most, count(*) AS n_events FROM events GROUP BY user_id")
def stream_job_state(spark, d):
    """The batch twin of the stream of the same name (streaming.jobs.latest_state)."""
    return J.latest_state(table(spark, d, "events"))


@query(f"""SELECT book_id, chapter_index, n_done FROM (SELECT book_id, chapter_index, count(DISTINCT segment_id) AS n_done FROM segment_timings WHERE audio_duration_seconds > 0 GROUP BY book_id, chapter_index) a
 JOIN (SELECT book_id, chapter_index, count(*) AS n_expected FROM {SEGMENTS} GROUP BY book_id, chapter_index) b USING (book_id, chapter_index) WHERE n_done >= n_expected""")
def stream_chapter_complete(spark, d):
    """The batch twin of the stream of the same name (streaming.jobs.complete_chapters)."""
    expected = once(table(spark, d, "tts_segments").select("segment_id", "book_id", "chapter_index"), "segment_id").groupBy("book_id", "chapter_index").agg(F.count("*").alias("n_expected"))
    return J.complete_chapters(table(spark, d, "segment_timings"), expected)


@query()
def epub_blocks(spark, d):
    """Detected chapters as EPUB files in memory, a file for each chapter, read again into blocks: the round trip of the format."""
    import pandas as pd

    from bookloom.sources import books

    def trip(batches):
        for b in batches:
            rows = []
            for book, chapter, title, paragraphs in zip(b.book_id, b.chapter_no, b.title, b.paragraphs):
                data = sinks.epub_bytes("book", [(title, list(paragraphs))])
                rows += [(book, chapter, j, kind, text) for _, _, _, j, kind, text in books.epub_blocks(data, skip=False)]
            yield pd.DataFrame(rows, columns=["book_id", "item_no", "block_no", "kind", "text"])

    return chapter_detect(spark, d).mapInPandas(trip, "book_id long, item_no int, block_no int, kind string, text string")


def queries():
    from bookloom.plans import books, more  # noqa: F401  register their queries

    return dict(QUERIES)


def oracles():
    queries()
    return dict(ORACLES)
