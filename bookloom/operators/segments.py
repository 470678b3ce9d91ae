"""Speech segments, their timings and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators.tables import running


def numbered_segments(texts: DataFrame, key: str) -> DataFrame:
    """Speech segments of each text with their place in it: (key, segment_no, segment)."""
    return texts.select(key, F.posexplode(T.speech_segments(F.col("text"))).alias("segment_no", "segment"))


def chapter_markers(timed: DataFrame) -> DataFrame:
    """Start and end seconds of each chapter of a book on its running time line.

    ``timed(book_id, chapter_index, segment_no, seconds)``; negative and null seconds count as 0.
    """
    base = timed.withColumn("seconds", F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0)))
    line = running(base, ["book_id"], ["chapter_index", "segment_no"], end=("seconds", "sum"))
    return line.groupBy("book_id", "chapter_index").agg(
        F.round(F.min(F.col("end") - F.col("seconds")), 3).alias("start_s"), F.round(F.max("end"), 3).alias("end_s"), F.count("*").alias("n_segments")
    )


def rtf_summary(timings: DataFrame, *by: str) -> DataFrame:
    """Mean, largest and slowest segment of the real-time factor; only attempts that have one count."""
    slowest = F.max_by(F.struct("segment_id", "attempt"), F.struct("rtf", -F.col("segment_id"), -F.col("attempt")))
    return timings.where("rtf is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("rtf"), 6).alias("avg_rtf"), F.max("rtf").alias("max_rtf"),
        slowest["segment_id"].alias("slowest_segment"), slowest["attempt"].alias("slowest_attempt"),
    )


def missing_segments(segments: DataFrame, timings: DataFrame) -> DataFrame:
    """Segments without a successful timing, by chapter; an anti join, so the sides may be of any size."""
    good = timings.where("audio_duration_seconds > 0").select("segment_id").distinct()
    return segments.join(good, "segment_id", "left_anti").groupBy("book_id", "chapter_index").agg(F.count("*").alias("n_missing"), F.min("segment_id").alias("first_missing"))


def quality(segments: DataFrame, timings: DataFrame) -> DataFrame:
    """Of each book: segments, segments to try again, the score and whether it passes (0.8)."""
    state = timings.groupBy("segment_id").agg(F.max(F.coalesce("audio_duration_seconds", F.lit(0.0))).alias("seconds"))
    per = segments.join(state, "segment_id", "left").groupBy("book_id").agg(
        F.count("*").alias("n_segments"), F.sum(F.when(F.coalesce("seconds", F.lit(0.0)) > 0, 0).otherwise(1)).alias("n_retry")
    )
    score = 1 - F.col("n_retry") / F.greatest("n_segments", F.lit(1))
    return per.select("book_id", "n_segments", "n_retry", F.round(score, 6).alias("score"), (score >= 0.8).alias("passed"))
