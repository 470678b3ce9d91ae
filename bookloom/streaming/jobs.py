"""Structured Streaming over state events and finished segments, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each user and how far it got: works on batches and, in complete or update mode, on streams."""
    best = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(best["event_type"].alias("last_type"), best["value"].alias("last_value"), F.max("value").alias("most"), F.count("*").alias("n_events"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events in windows of event time; a stream keeps a window until the watermark passes it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def complete_chapters(timings: DataFrame, expected: DataFrame) -> DataFrame:
    """Chapters of which every expected segment has a good timing.

    ``expected(book_id, chapter_index, n_expected)`` is static.  Attempts of a segment
    count once through a set of distinct hashes' exact count on batches, and through
    stateful deduplication on streams.
    """
    good = timings.where("audio_duration_seconds > 0").select("segment_id", "book_id", "chapter_index")
    done = good.dropDuplicates(["segment_id"]).groupBy("book_id", "chapter_index").agg(F.count("*").alias("n_done"))
    return done.join(expected, ["book_id", "chapter_index"]).where("n_done >= n_expected").select("book_id", "chapter_index", "n_done")


def run_to_table(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and return its result."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)


def streamed(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming frame over a folder of parquet files with the folder's schema."""
    return shape(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
