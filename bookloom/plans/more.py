"""Queries over pages, blocks, segments, timings and jobs: cleaning, gaps, reports, payloads; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators import chapters as C
from bookloom.operators import documents as D
from bookloom.operators.tables import once, once_of, table
from bookloom.plans.books import CHAPTERS, JOBS, segments
from bookloom.plans.catalogue import BEST_TIMING, KEY_SQL, LINES, PARAGRAPHS, SEGMENTS, TIMINGS, _clean_sql, _noise_sql, docs, normal, query

PAGES = "(SELECT DISTINCT ON (page_id) * FROM source_pages)"
# The share of the way that is done when a stage begins.
STAGES = {"parse": 0.02, "clean": 0.06, "analyze": 0.1, "generate": 0.15, "package": 0.95, "done": 1.0}
#: Lines that a look at a log shows, and failures that a report lists.
TAIL, FAILURES = 200, 5


def _noise_line_sql(c: str) -> str:
    words = "'" + "', '".join(T.NOISE_LINES) + "'"
    plain = T.NOISE_LINE.replace("(?iu)", "(?i)").replace("(?<![\\p{L}\\p{N}_])", "(?:^|[^\\p{L}\\p{N}_])").replace("(?![\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])")
    return f"({c} = '' OR {c} IN ({words}) OR regexp_matches({c}, '{plain}'))"


@query(f"""SELECT page_id, CAST(i AS INTEGER) AS line_no, line FROM (SELECT page_id, i, {normal('raw')} AS line FROM (SELECT page_id, unnest(generate_series(0, len(lines) - 1)) AS i, unnest(lines) AS raw FROM {PAGES}))
 WHERE NOT {_noise_line_sql('line')}""")
def clean_lines(spark, d):
    """Lines of pages, normalised, without those that are never part of a book's text; numbers stay those of the page."""
    p = once_of(spark, d, "source_pages", ["page_id"], ["lines"])
    lines = p.select("page_id", F.posexplode("lines").alias("line_no", "raw")).select("page_id", "line_no", T.normalize_space(F.col("raw")).alias("line"))
    return lines.where(~T.is_noise_line(F.col("line")))


@query(f"""SELECT book_id, count(*) AS n_lines, CAST(sum(CASE WHEN r.key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated FROM (SELECT book_id, {KEY_SQL} AS key FROM (SELECT book_id, unnest(lines) AS line FROM {PAGES}) WHERE line IS NOT NULL) l
 LEFT JOIN (SELECT book_id, key FROM (SELECT book_id, {KEY_SQL} AS key FROM (SELECT book_id, unnest(lines) AS line FROM {PAGES})) WHERE key <> '' GROUP BY book_id, key HAVING count(*) >= 3 AND len(regexp_extract_all(key, '{T.NON_WS}+')) <= 14) r USING (book_id, key) GROUP BY book_id""")
def repeats_removed(spark, d):
    """Lines of each book, and how many of them ``without_repeats`` removes."""
    p = once_of(spark, d, "source_pages", ["page_id"], ["book_id", "lines"])
    lines = p.select("book_id", F.explode("lines").alias("text")).where("text is not null").withColumn("is_heading", F.lit(False))
    left = C.without_repeats(lines).groupBy("book_id").agg(F.count("*").alias("n_left"))
    every = lines.groupBy("book_id").agg(F.count("*").alias("n_lines"))
    return every.join(left, "book_id", "left").select("book_id", "n_lines", (F.col("n_lines") - F.coalesce("n_left", F.lit(0))).alias("n_repeated"))


PROMOTED_SQL = T.PROMOTED.replace("(?iu)", "(?i)")


@query(f"""SELECT paragraph_id, text, len(regexp_extract_all(text, '{T.NON_WS}+')) < 10 AND regexp_matches(text, '{PROMOTED_SQL}') AS is_heading FROM (
 SELECT paragraph_id, {_clean_sql()} AS text FROM {PARAGRAPHS} WHERE text IS NOT NULL) WHERE text <> '' AND {_noise_sql('text')} IS NULL""")
def cleaned_blocks(spark, d):
    """Paragraphs cleaned for speech, without empty and noise blocks; short ones that begin like a chapter are headings."""
    p = once_of(spark, d, "paragraphs", ["paragraph_id"], ["text"], "text is not null").select("paragraph_id", F.explode(F.array(T.clean_text(F.col("text")))).alias("text"))  # worked out once
    return p.where((F.col("text") != "") & T.noise_rule(F.col("text")).isNull()).withColumn("is_heading", T.is_promoted(F.col("text")))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS part_no, part FROM (SELECT doc_id, unnest(p) AS part, unnest(generate_series(0, len(p) - 1)) AS i FROM (
 SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda s: {normal('s')}), lambda s: s <> '') AS p FROM documents WHERE text IS NOT NULL) WHERE len(p) > 0)""")
def blank_line_parts(spark, d):
    """Texts in parts at blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t]*\n+"), T.normalize_space), lambda s: s != "")
    return docs(spark, d).select("doc_id", F.posexplode(parts).alias("part_no", "part"))


@query(f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, raw AS line FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM ({LINES})) WHERE line_no > last - {TAIL}""")
def log_tail(spark, d):
    """The last lines of each text, as a log is looked at."""
    lines = T.lines(F.col("text"))
    first = F.greatest(F.size("lines") - TAIL, F.lit(0))
    x = docs(spark, d).select("doc_id", lines.alias("lines")).select("doc_id", first.alias("first"), F.posexplode(F.slice("lines", first + 1, TAIL)).alias("k", "line"))
    return x.select("doc_id", (F.col("first") + F.col("k")).alias("line_no"), "line")


@query(f"""SELECT book_id, chapter_index, count(*) AS paragraph_count, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{T.NON_WS}+'))) AS BIGINT) AS word_count FROM {PARAGRAPHS} GROUP BY book_id, chapter_index""")
def chapter_summaries(spark, d):
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "book_id", "chapter_index", T.word_count(F.coalesce("text", F.lit(""))).alias("w")), "paragraph_id")
    return p.groupBy("book_id", "chapter_index").agg(F.count("*").alias("paragraph_count"), F.sum("w").alias("word_count"))


@query(f"""SELECT book_id, greatest(count(*) FILTER (regexp_matches(chapter_title, '{C.BARE.replace('(?iu)', '(?i)')}')), 1) AS n_headings FROM {CHAPTERS} GROUP BY book_id""")
def heading_counts(spark, d):
    """Bare chapter markers among a book's titles; a book without any counts as one heading."""
    c = once(table(spark, d, "chapters").select("chapter_id", "book_id", "chapter_title"), "chapter_id")
    return c.groupBy("book_id").agg(F.greatest(F.count_if(F.col("chapter_title").rlike(C.BARE)), F.lit(1)).alias("n_headings"))


@query(f"""SELECT book_id, list(error ORDER BY first) AS warnings FROM (SELECT book_id, error, min((segment_id, attempt)) AS first FROM {TIMINGS} WHERE error IS NOT NULL GROUP BY book_id, error) GROUP BY book_id""")
def distinct_warnings(spark, d):
    """A book's different error texts in the order in which they first came up."""
    t = once(table(spark, d, "segment_timings").select("segment_id", "attempt", "book_id", "error"), "segment_id", "attempt").where("error is not null")
    first = t.groupBy("book_id", "error").agg(F.min(F.struct("segment_id", "attempt")).alias("first"))
    each = first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("first", "error"))).alias("w"))
    return each.select("book_id", F.transform("w", lambda x: x["error"]).alias("warnings"))


@query(f"""SELECT reason, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS percent FROM (SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN regexp_matches(text, '[0-9]') THEN 'digit' WHEN regexp_matches(text, '(?:[a-zA-Z]\\.){{2,}}|[A-Z]{{2,}}') THEN 'acronym'
 WHEN NOT regexp_matches(text, '[.,?!]$') THEN 'end' WHEN s IS NULL OR s < 3 THEN 'short' WHEN s > 15 THEN 'long' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT g.text, b.seconds AS s FROM {SEGMENTS} g LEFT JOIN {BEST_TIMING} b USING (segment_id)) GROUP BY 1)""")
def filter_report(spark, d):
    """Speech-training samples by reason, with their percentage."""
    s = once(table(spark, d, "tts_segments").select("segment_id", "text"), "segment_id")
    t = table(spark, d, "segment_timings").groupBy("segment_id").agg(F.max(F.when(F.col("audio_duration_seconds") > 0, F.col("audio_duration_seconds"))).alias("s"))
    n = s.join(t, "segment_id", "left").groupBy(T.training_reason(F.col("text"), F.col("s")).alias("reason")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row; there are seven reasons
    return n.crossJoin(F.broadcast(total)).select("reason", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


@query(f"""SELECT book_id, chapter_index, n_text, n_audio, CASE WHEN n_text > n_audio THEN generate_series(n_audio, n_text - 1) ELSE [] END AS retry FROM (
 SELECT s.book_id, s.chapter_index, count(*) AS n_text, count(b.seconds) AS n_audio FROM {SEGMENTS} s LEFT JOIN {BEST_TIMING} b USING (segment_id) GROUP BY s.book_id, s.chapter_index)""")
def positional_gaps(spark, d):
    """Chapters with fewer recordings than segments: the positions that are missing if recordings stand first."""
    s = segments(spark, d, "book_id", "chapter_index")
    t = table(spark, d, "segment_timings").where("audio_duration_seconds > 0").select("segment_id").distinct().withColumn("ok", F.lit(1))
    n = s.join(t, "segment_id", "left").groupBy("book_id", "chapter_index").agg(F.count("*").alias("n_text"), F.count("ok").alias("n_audio"))
    gap = F.when(F.col("n_text") > F.col("n_audio"), F.sequence("n_audio", F.col("n_text") - 1)).otherwise(F.array().cast("array<bigint>"))
    return n.select("book_id", "chapter_index", "n_text", "n_audio", gap.alias("retry"))


@query(f"""SELECT book_id, list(segment_id ORDER BY segment_id) AS failed FROM (SELECT book_id, segment_id, row_number() OVER (PARTITION BY book_id ORDER BY segment_id) AS r FROM (SELECT DISTINCT book_id, segment_id FROM {TIMINGS} WHERE status = 'failed')) WHERE r <= {FAILURES} GROUP BY book_id""")
def first_failures(spark, d):
    """The first failed segments of each book; a bounded aggregation, so that a book with many isn't gathered."""
    t = table(spark, d, "segment_timings").where("status = 'failed'").select("book_id", "segment_id").distinct()
    spread = t.groupBy("book_id", F.pmod(F.xxhash64("segment_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("segment_id")), 1, FAILURES).alias("some"))
    return spread.groupBy("book_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, FAILURES).alias("failed"))


@query(f"""SELECT segment_id FROM {SEGMENTS} ORDER BY md5(CAST(segment_id AS VARCHAR)), segment_id LIMIT 500""")
def shuffled_sample(spark, d):
    """500 segments in a fixed random order."""
    return segments(spark, d).orderBy(F.md5(F.col("segment_id").cast("string").cast("binary")), "segment_id").limit(500)


@query("""SELECT label, round(sum(m * m), 6) AS square, count(*) AS n FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label""")
def mean_pooled(spark, d):
    """Vectors pooled by label: the mean of each coordinate, shown by its square sum."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("square"), F.count("*").alias("n"))


@query("SELECT vec_id, CASE WHEN score < 0.3 THEN -1 ELSE label END AS label FROM (SELECT e.vec_id, arg_max(c.label, (s, -c.label)) AS label, max(s) AS score FROM (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS s FROM embeddings e, (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) c) t JOIN embeddings e USING (vec_id) JOIN (SELECT DISTINCT label FROM embeddings) c ON c.label = t.label GROUP BY e.vec_id)")
def label_or_default(spark, d):
    """The nearest label where it is near enough (0.3), else the default -1."""
    from bookloom.plans.catalogue import QUERIES

    return QUERIES["semantic_label"](spark, d).select("vec_id", F.when(F.col("score") < 0.3, -1).otherwise(F.col("label")).alias("label"))


@query(f"""SELECT job_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created, coalesce(CAST(epoch_us(completed_at) - epoch_us(started_at) AS BIGINT) // 1000000, -1) AS took_s FROM {JOBS}""")
def job_times(spark, d):
    """When jobs came in, as ISO text, and the whole seconds they took; -1 where they aren't over."""
    j = once(table(spark, d, "jobs").select("job_id", "created_at", "started_at", "completed_at"), "job_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return j.select("job_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.coalesce(F.floor((micros("completed_at") - micros("started_at")) / 1_000_000), F.lit(-1)).alias("took_s"))


@query(f"""SELECT segment_id, round(coalesce(speed, 1.0) * floor(100 * (CASE lower(coalesce(emotion, 'neutral')) WHEN 'angry' THEN 1 + 0.5::DOUBLE * i WHEN 'sad' THEN 1 - 0.3::DOUBLE * i WHEN 'happy' THEN 1 + 0.4::DOUBLE * i ELSE 1.0::DOUBLE END) + 0.5) / 100, 4) AS speed, coalesce(voice_id, 'default') AS voice_id,
 printf('seg_%04d_%s.wav', segment_index, coalesce(voice_id, 'default')) AS path FROM (SELECT *, coalesce(intensity, 1.0) AS i FROM {SEGMENTS})""")
def segment_payloads(spark, d):
    """What a speech engine is asked for: the segment's own speed times that of its emotion, its voice and its file."""
    from bookloom.functions import arrays as A
    from bookloom.functions import names as N

    s = segments(spark, d, "segment_index", "speed", "voice_id", "emotion", "intensity")
    speed = F.coalesce("speed", F.lit(1.0)) * A.prosody(F.col("emotion"), F.col("intensity"))["speed"]
    return s.select("segment_id", F.round(speed, 4).alias("speed"), F.coalesce("voice_id", F.lit("default")).alias("voice_id"), N.segment_file(F.col("segment_index"), F.col("voice_id")).alias("path"))


@query(f"""SELECT paragraph_id, printf('[%04d] page=%s type=%s', paragraph_index, coalesce(CAST(page_start AS VARCHAR), '-'), coalesce(origin, '-')) AS line FROM {PARAGRAPHS} WHERE paragraph_index IS NOT NULL""")
def block_dump(spark, d):
    """A line for each block, to look at."""
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "paragraph_index", "page_start", "origin").where("paragraph_index is not null"), "paragraph_id")
    return p.select("paragraph_id", F.format_string("[%04d] page=%s type=%s", "paragraph_index", F.coalesce(F.col("page_start").cast("string"), F.lit("-")), F.coalesce("origin", F.lit("-"))).alias("line"))


@query(f"""SELECT job_id, 'book_id=' || CAST(book_id AS VARCHAR) || ' stage=' || coalesce(stage, '-') || ' status=' || coalesce(status, '-') AS message FROM {JOBS} WHERE book_id IS NOT NULL""")
def key_value_lines(spark, d):
    """Jobs as key=value lines, keys in order; nulls show as '-'."""
    j = once(table(spark, d, "jobs").select("job_id", "book_id", "stage", "status").where("book_id is not null"), "job_id")
    pairs = F.create_map(F.lit("book_id"), F.col("book_id").cast("string"), F.lit("stage"), F.coalesce("stage", F.lit("-")), F.lit("status"), F.coalesce("status", F.lit("-")))
    return j.select("job_id", F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("message"))


@query(f"""SELECT doc_id, detected = 'vi' AS accepted FROM (SELECT doc_id, CASE WHEN regexp_replace(h, '{T.WS}+', '', 'g') = '' THEN 'unknown' WHEN (length(h) - length(regexp_replace(h, '[{T.VIETNAMESE}]', '', 'g')))::DOUBLE / length(h) >= 0.015 THEN 'vi' ELSE 'en' END AS detected FROM (SELECT doc_id, substring(text, 1, 5000) AS h FROM documents WHERE text IS NOT NULL))""")
def language_gate(spark, d):
    """Whether a text passes a gate for Vietnamese."""
    return docs(spark, d).select("doc_id", (T.language(F.col("text")) == "vi").alias("accepted"))


@query(f"""SELECT book_id, CAST(heading_no AS INTEGER) AS chapter_no, coalesce(title, 'Mở đầu') AS title, n_blocks FROM (
 SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY c) - 1 AS heading_no FROM (SELECT book_id, c, max(CASE WHEN is_heading THEN trim(text, ' ') END) AS title, CAST(sum(CASE WHEN NOT is_heading THEN 1 ELSE 0 END) AS INTEGER) AS n_blocks FROM (
  SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY chapter_index, paragraph_index, paragraph_id) AS c FROM (
   SELECT book_id, chapter_index, paragraph_index, paragraph_id, text, len(regexp_extract_all(text, '{T.NON_WS}+')) < 10 AND regexp_matches(text, '{PROMOTED_SQL}') AS is_heading FROM (SELECT * REPLACE ({_clean_sql()} AS text) FROM {PARAGRAPHS} WHERE text IS NOT NULL) WHERE trim(text, ' ') <> ''))
  GROUP BY book_id, c) WHERE n_blocks > 0)""")
def blocks_to_chapters(spark, d):
    """Cleaned blocks grouped into chapters at the headings among them."""
    p = once_of(spark, d, "paragraphs", ["paragraph_id"], ["book_id", "chapter_index", "paragraph_index", "text"], "text is not null")
    b = p.select("book_id", F.struct("chapter_index", "paragraph_index", "paragraph_id").alias("block_no"), F.explode(F.array(T.clean_text(F.col("text")))).alias("text")).where(F.trim("text") != "")
    return C.grouped_blocks(b.withColumn("is_heading", T.is_promoted(F.col("text")))).drop("text").withColumn("n_blocks", F.col("n_blocks").cast("int"))


@query(f"""SELECT doc_id, CASE WHEN file_format IS NULL THEN 'no file' WHEN lower(file_format) IN ('mp3', 'wav', 'm4a') THEN 'audio' ELSE 'text: ' || lower(file_format) END AS message FROM documents""")
def format_messages(spark, d):
    """A message by the format of a document's file."""
    f = F.lower("file_format")
    return table(spark, d, "documents").select("doc_id", F.when(f.isNull(), "no file").when(f.isin("mp3", "wav", "m4a"), "audio").otherwise(F.concat(F.lit("text: "), f)).alias("message"))


@query(f"""SELECT book_id, round(0.15 + 0.8 * n_done / n_segments, 6) AS progress FROM (SELECT s.book_id, count(*) AS n_segments, count(b.seconds) AS n_done FROM {SEGMENTS} s LEFT JOIN {BEST_TIMING} b USING (segment_id) GROUP BY s.book_id)""")
def generation_progress(spark, d):
    """How far the recording of a book is, on the way from its stage's beginning to the next one's."""
    s = segments(spark, d, "book_id")
    t = table(spark, d, "segment_timings").where("audio_duration_seconds > 0").select("segment_id").distinct().withColumn("ok", F.lit(1))
    n = s.join(t, "segment_id", "left").groupBy("book_id").agg(F.count("*").alias("n"), F.count("ok").alias("done"))
    return n.select("book_id", F.round(STAGES["generate"] + (STAGES["package"] - STAGES["generate"]) * F.col("done") / F.col("n"), 6).alias("progress"))


@query(f"""SELECT job_id, coalesce(voice_id, json_extract_string(payload, '$.voice_id'), 'default') AS voice FROM {JOBS}""")
def job_voices(spark, d):
    """A job's voice: its own, else the one in its payload, else the default."""
    j = once(table(spark, d, "jobs").select("job_id", "voice_id", "payload"), "job_id")
    return j.select("job_id", F.coalesce("voice_id", F.get_json_object("payload", "$.voice_id"), F.lit("default")).alias("voice"))


@query("""SELECT doc_id, name, n, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, name, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM (SELECT doc_id, name, count(*) AS n, min(pos) AS pos FROM (
 SELECT doc_id, unnest(w) AS name, unnest(generate_series(1, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '#[A-Za-z_]+') AS w FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id, name)) WHERE rank <= 5""")
def hashtags_top5(spark, d):
    """The most frequent tags of each text, ties by first use: the counting of ``documents`` with another pattern."""
    import re

    tags = re.compile("#[A-Za-z_]+")
    return docs(spark, d).select("doc_id", "text").mapInPandas(D._most_used(tags.findall, "doc_id", "name", 5), "doc_id long, name string, n long, rank int")
