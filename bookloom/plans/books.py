"""Queries that join chapters, segments, voices and jobs, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from bookloom.functions import names as N
from bookloom.functions import text as T
from bookloom.operators import documents as D
from bookloom.operators.tables import once, running, table
from bookloom.plans.catalogue import BEST_TIMING, PARAGRAPHS, SEGMENTS, SENTENCES_SQL, TIMINGS, docs, query
from bookloom.sources import sinks

CHAPTERS = "(SELECT DISTINCT ON (chapter_id) * FROM chapters)"
JOBS = "(SELECT DISTINCT ON (job_id) * FROM jobs)"
# Moods and the voice that suits them; the first that holds decides.
VOICE_RULES = [("angry|tense|dramatic", "male_hn_02"), ("sad|solemn|calm", "male_hn_01"), ("happy|playful", "female_hcm_02"), ("romantic|warm|tender", "female_hn_01")]
NARRATOR = "female_hn_02"


def segments(spark, d, *columns):
    return once(table(spark, d, "tts_segments").select("segment_id", *columns), "segment_id")


@query(f"""SELECT segment_id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, segment_index, segment_id) - 1 AS global_no FROM {SEGMENTS}""")
def global_segments(spark, d):
    """Segments numbered through each book from 0."""
    s = segments(spark, d, "book_id", "chapter_index", "segment_index").withColumn("one", F.lit(1))
    n = running(s, ["book_id"], ["chapter_index", "segment_index", "segment_id"], n=("one", "count"))
    return n.select("segment_id", "book_id", (F.col("n") - 1).alias("global_no"))


@query("""SELECT event_id, user_id, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def carry_nonzero(spark, d):
    """The last value of each user that isn't zero."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.nullif("value", F.lit(0.0)).alias("v"))
    return running(e, ["user_id"], ["ts", "event_id"], carried=("v", "last")).select("event_id", "user_id", "carried")


@query("""SELECT user_id, count(*) AS n_changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id""")
def log_changes(spark, d):
    """How often a user's state line changes; the line before comes from running values, so a busy user is spread."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    e = running(e, ["user_id"], ["ts", "event_id"], before=("event_type", "lag"))
    return e.where("before is null or before <> event_type").groupBy("user_id").agg(F.count("*").alias("n_changes"))


@query(f"""SELECT s.segment_id, coalesce(c.chapter_title, 'Chapter ' || CAST(s.chapter_index + 1 AS VARCHAR)) AS title, substring(s.text, 1, 120) AS preview, round(b.seconds, 3) AS seconds
 FROM {SEGMENTS} s LEFT JOIN (SELECT book_id, chapter_index, arg_min(chapter_title, chapter_id) AS chapter_title FROM {CHAPTERS} WHERE chapter_title IS NOT NULL GROUP BY book_id, chapter_index) c
 ON c.book_id = s.book_id AND c.chapter_index = s.chapter_index LEFT JOIN {BEST_TIMING} b ON b.segment_id = s.segment_id""")
def segment_previews(spark, d):
    """Segments with their chapter's title (or its number), the head of their text and their best timing."""
    s = segments(spark, d, "book_id", "chapter_index", F.substring("text", 1, 120).alias("preview"))
    c = table(spark, d, "chapters").where("chapter_title is not null").groupBy("book_id", "chapter_index").agg(F.min_by("chapter_title", "chapter_id").alias("chapter_title"))
    t = table(spark, d, "segment_timings").groupBy("segment_id").agg(F.max(F.when(F.col("audio_duration_seconds") > 0, F.col("audio_duration_seconds"))).alias("seconds"))
    title = F.coalesce("chapter_title", F.concat(F.lit("Chapter "), (F.col("chapter_index") + 1).cast("string")))
    return s.join(c, ["book_id", "chapter_index"], "left").join(t, "segment_id", "left").select("segment_id", title.alias("title"), "preview", F.round("seconds", 3).alias("seconds"))


@query(f"""SELECT speaker, arg_max(emotion, (n, -first_id)) AS emotion, max(n) AS n FROM (SELECT speaker, emotion, count(*) AS n, min(segment_id) AS first_id FROM {SEGMENTS}
 WHERE speaker IS NOT NULL AND emotion IS NOT NULL AND lower(speaker) <> 'narrator' GROUP BY speaker, emotion) GROUP BY speaker""")
def speaker_emotion(spark, d):
    """The emotion each speaker has most, narrators left out, ties to the one met first."""
    s = segments(spark, d, "speaker", "emotion").where("speaker is not null and emotion is not null and lower(speaker) <> 'narrator'")
    each = s.groupBy("speaker", "emotion").agg(F.count("*").alias("n"), F.min("segment_id").alias("first_id"))
    return each.groupBy("speaker").agg(F.max_by("emotion", F.struct("n", -F.col("first_id"))).alias("emotion"), F.max("n").alias("n"))


@query(f"""SELECT s.segment_id, CASE WHEN v.voice_id IS NOT NULL THEN v.voice_id WHEN n.voice_id IS NOT NULL THEN n.voice_id ELSE (SELECT min(voice_id) FROM voices) END AS voice FROM (
 SELECT segment_id, CASE {' '.join(f"WHEN regexp_matches(coalesce(emotion, ''), '{p}') THEN '{v}'" for p, v in VOICE_RULES)} ELSE '{NARRATOR}' END AS wanted FROM {SEGMENTS}) s
 LEFT JOIN voices v ON v.voice_id = s.wanted LEFT JOIN voices n ON n.voice_id = '{NARRATOR}'""")
def voice_rules(spark, d):
    """A voice for each segment by rules on its emotion; where it isn't in the catalogue, the narrator's, else the first."""
    wanted = None
    for p, v in VOICE_RULES:
        hit = F.coalesce("emotion", F.lit("")).rlike(p)
        wanted = F.when(hit, v) if wanted is None else wanted.when(hit, v)
    s = segments(spark, d, "emotion").select("segment_id", wanted.otherwise(NARRATOR).alias("wanted"))
    v = table(spark, d, "voices").select("voice_id").distinct()
    # two joins on the voice: with the one that is wanted, and with the narrator's for those that aren't there
    narrator = v.where(F.col("voice_id") == NARRATOR).select(F.col("voice_id").alias("narrator"))
    first = F.lit(v.agg(F.min("voice_id")).first()[0])
    s = s.withColumn("narrator_wanted", F.lit(NARRATOR)).join(v, s.wanted == v.voice_id, "left").join(narrator, F.col("narrator_wanted") == F.col("narrator"), "left")
    return s.select("segment_id", F.coalesce("voice_id", "narrator", first).alias("voice"))


@query()
def speaker_tags(spark, d):
    """Of each segment the first of its book's frequent names that it mentions, else the narrator."""
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "book_id", "text").where("text is not null"), "paragraph_id")
    found = F.regexp_extract_all("text", F.lit(r"(?U)\b[A-ZÀ-Ỹ][a-zà-ỹ]+\s[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s[A-ZÀ-Ỹ][a-zà-ỹ]+)*\b"), F.lit(0))
    counts = p.select("book_id", F.explode(found).alias("name")).groupBy("book_id", "name").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("book_id").orderBy(F.desc("n"), "name")
    top = counts.withColumn("r", F.row_number().over(rank)).where("r <= 5").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("names"))
    s = segments(spark, d, "book_id", "text").join(top, "book_id", "left")
    first = F.filter("names", lambda x: F.contains(F.lower(F.col("text")), F.lower(x["name"])))
    return s.select("segment_id", F.coalesce(F.try_element_at(first, F.lit(1))["name"], F.lit("narrator")).alias("speaker"))


@query(f"""SELECT book_id, CAST(sentence_no AS INTEGER) AS sentence_no, sentence FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, k) - 1 AS sentence_no FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY i) AS k FROM (
   SELECT *, greatest(1, n // per) AS step FROM (
    SELECT *, greatest(1, 60 // n_chapters) AS per FROM (
     SELECT *, count(*) OVER (PARTITION BY book_id, chapter_index) AS n, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY paragraph_index, paragraph_id, sn) - 1 AS i FROM (
      SELECT book_id, chapter_index, paragraph_index, paragraph_id, unnest(generate_series(0, len(s) - 1)) AS sn, unnest(s) AS sentence FROM (
       SELECT *, list_filter({SENTENCES_SQL}, lambda s: length(s) > 10) AS s FROM {PARAGRAPHS} WHERE text IS NOT NULL) WHERE len(s) > 0))
     JOIN (SELECT book_id, count(DISTINCT chapter_index) AS n_chapters FROM paragraphs GROUP BY book_id) USING (book_id))) WHERE i % step = 0) WHERE k <= per) WHERE sentence_no < 60""")
def distributed_sample(spark, d):
    """Sixty sentences of a book, spread evenly over its chapters and each chapter."""
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "book_id", "chapter_index", "paragraph_index", "text").where("text is not null"), "paragraph_id")
    long = F.filter(T.sentences(F.col("text")), lambda s: F.length(s) > 10)
    s = p.select("book_id", "chapter_index", "paragraph_index", "paragraph_id", F.posexplode(long).alias("sn", "sentence"))
    s = running(s.withColumn("one", F.lit(1)), ["book_id", "chapter_index"], ["paragraph_index", "paragraph_id", "sn"], i=("one", "count"))
    n = s.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"))
    c = table(spark, d, "paragraphs").groupBy("book_id").agg(F.countDistinct("chapter_index").alias("n_chapters"))
    per = F.greatest(F.lit(1), F.floor(60 / F.col("n_chapters")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("per")))
    s = s.join(n, ["book_id", "chapter_index"]).join(c, "book_id").withColumn("per", per).withColumn("step", step)
    s = s.where("(i - 1) % step = 0 and (i - 1) / step < per")
    # at most 60 and one for each further chapter of a book are left
    rank = Window.partitionBy("book_id").orderBy("chapter_index", "i")
    return s.withColumn("sentence_no", F.row_number().over(rank) - 1).where("sentence_no < 60").select("book_id", "sentence_no", "sentence")


@query(f"""SELECT book_id, count(*) AS n_paragraphs, count(DISTINCT chapter_index) AS n_chapters, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{T.NON_WS}+'))) AS BIGINT) AS n_words, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars,
 CAST(coalesce(max(page_end), 0) AS INTEGER) AS total_pages FROM {PARAGRAPHS} GROUP BY book_id""")
def book_stats(spark, d):
    p = once(table(spark, d, "paragraphs").select("paragraph_id", "book_id", "chapter_index", "text", "page_end"), "paragraph_id")
    t = F.coalesce("text", F.lit(""))
    return p.groupBy("book_id").agg(
        F.count("*").alias("n_paragraphs"), F.countDistinct("chapter_index").alias("n_chapters"), F.sum(T.word_count(t)).alias("n_words"),
        F.sum(F.length(t)).alias("n_chars"), F.coalesce(F.max("page_end"), F.lit(0)).alias("total_pages"),
    )


@query(f"""SELECT book_id, chapter_index, list_sort(list(segment_id)) AS expected_but_missing FROM {SEGMENTS} WHERE segment_id NOT IN (SELECT segment_id FROM segment_timings WHERE audio_duration_seconds > 0) GROUP BY book_id, chapter_index""")
def missing_lists(spark, d):
    """The set of a chapter's segments without a good timing, sorted."""
    good = table(spark, d, "segment_timings").where("audio_duration_seconds > 0").select("segment_id").distinct()
    return segments(spark, d, "book_id", "chapter_index").join(good, "segment_id", "left_anti").groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list("segment_id")).alias("expected_but_missing"))


@query(f"SELECT job_id, book_id, status FROM {JOBS} ORDER BY created_at DESC, job_id LIMIT 50")
def jobs_latest_top50(spark, d):
    return once(table(spark, d, "jobs").select("job_id", "book_id", "status", "created_at"), "job_id").orderBy(F.desc("created_at"), "job_id").limit(50).select("job_id", "book_id", "status")


@query(f"""SELECT lower(regexp_extract(input_file, '\\.([^./\\\\]+)$', 1)) AS file_type, count(*) AS n, count(DISTINCT book_id) AS n_books FROM {JOBS} GROUP BY 1""")
def job_file_types(spark, d):
    j = once(table(spark, d, "jobs").select("job_id", "book_id", "input_file"), "job_id")
    return j.groupBy(N.file_type(F.col("input_file")).alias("file_type")).agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("n_books"))


@query(f"SELECT segment_id, printf('seg_%04d_%s.wav', segment_index, coalesce(voice_id, 'default')) AS file_name FROM {SEGMENTS}")
def segment_files(spark, d):
    return segments(spark, d, "segment_index", "voice_id").select("segment_id", N.segment_file(F.col("segment_index"), F.col("voice_id")).alias("file_name"))


@query()
def chapter_metadata(spark, d):
    """Chapter marks of a book's audio file, in milliseconds, empty chapters left out."""
    from bookloom.plans.catalogue import QUERIES

    marks = QUERIES["chapter_markers"](spark, d)
    c = table(spark, d, "chapters").where("chapter_title is not null").groupBy("book_id", "chapter_index").agg(F.min_by("chapter_title", "chapter_id").alias("title"))
    text = sinks.ffmetadata(F.coalesce("title", F.format_string("Chapter %d", F.col("chapter_index") + 1)), F.col("start_s"), F.col("end_s"))
    return marks.join(c, ["book_id", "chapter_index"], "left").select("book_id", "chapter_index", text.alias("metadata")).where("metadata is not null")


@query()
def titles_composed(spark, d):
    """Chapter titles in composed form."""
    return once(table(spark, d, "chapters").select("chapter_id", "chapter_title"), "chapter_id").select("chapter_id", N.nfc(F.col("chapter_title")).alias("title"))


def _synthesise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a speech engine: seconds by length; a row that fails says why and doesn't stop the batch."""
    for b in batches:
        out = []
        for key, text in zip(b.segment_id, b.text):
            try:
                if not text.strip():
                    raise ValueError("empty text")
                out.append((key, "ok", None, round(0.06 * len(text), 3)))
            except (AttributeError, ValueError) as e:
                out.append((key, "failed", str(e)[:50], None))
        yield pd.DataFrame(out, columns=["segment_id", "status", "error", "seconds"])


@query(f"SELECT CASE WHEN text IS NULL OR regexp_replace(text, '{T.WS}+', '', 'g') = '' THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM {SEGMENTS} GROUP BY 1")
def batch_with_errors(spark, d):
    """A batch map that keeps each row's error beside its result."""
    done = segments(spark, d, "text").mapInPandas(_synthesise, "segment_id long, status string, error string, seconds double")
    return done.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT book_id, count(*) AS n_timed, round(sum(audio_duration_seconds), 3) AS audio_s, round(sum(tts_wall_seconds) / sum(audio_duration_seconds), 4) AS rtf FROM {TIMINGS} WHERE audio_duration_seconds > 0 GROUP BY book_id""")
def book_rtf(spark, d):
    t = once(table(spark, d, "segment_timings").select("segment_id", "attempt", "book_id", "audio_duration_seconds", "tts_wall_seconds"), "segment_id", "attempt").where("audio_duration_seconds > 0")
    return t.groupBy("book_id").agg(F.count("*").alias("n_timed"), F.round(F.sum("audio_duration_seconds"), 3).alias("audio_s"), F.round(F.sum("tts_wall_seconds") / F.sum("audio_duration_seconds"), 4).alias("rtf"))


@query()
def pipeline_report(spark, d):
    """A line of text about each book: segments, time spoken, speed."""
    r = book_rtf(spark, d)
    return r.select("book_id", F.format_string("book %d: %d segments, %s, real-time factor %.2f", "book_id", "n_timed", N.duration(F.col("audio_s")), "rtf").alias("line"))


@query()
def map_reduce_summary(spark, d):
    """Chunks of 700 words, a summary of each, and the summary of those: the shape into which a model is plugged."""
    from bookloom.plans.catalogue import QUERIES

    parts = QUERIES["word_chunks_700"](spark, d).mapInPandas(D.sentence_stub, "doc_id long, chunk_no int, summary string")
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "summary"))).alias("s"))
    return joined.select("doc_id", F.substring(F.array_join(F.transform("s", lambda x: x["summary"]), " \n "), 1, 200).alias("summary"))


@query()
def expanded_abbreviations(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.expand_abbreviations(F.col("text")).cast("binary")).alias("digest"))
