"""Problem 8: sources combined to target weights.

Documents get a hash-random key and are sorted by range on (source, key), so a
source of any size is spread over as many ranges as its rows need.  Each range
sums up its token counts as it is written; ranges' totals, a table of at most
ranges times sources rows, give each range its offset in the source.  A document
is used once for each full epoch of its source's budget and once more if its
prefix sum lies within what is left.

The size of the mixture is the largest at which no source is repeated more than
it may be, unless a size is given.

Defined results
---------------
* documents without tokens (null, empty) and documents of unlisted or null
  sources are not used; a source with a share of zero or null gives nothing.
* a source without documents can't reach its share; the others keep theirs.
* ``max_repeats`` below 1 or null gives nothing of that source.
* a size above what the limits allow: each source gives all it may.
* a document is used at most ``max_repeats`` times; a source's total is within
  one document of its budget.  Equal keys are ordered by ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import materialise, table
from bookloom.llm.tokenize import token_counts

#: Seed of the hash-random keys.
SEED = 20_24

SUMS = "doc_id long, source string, n_tokens long, part int, local_sum long"


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prefix sums within a sorted range, by source; they go on from batch to batch."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last: dict[str, int] = {}
    for b in batches:
        sums = b.groupby("source").n_tokens.cumsum() + b.source.map(last).fillna(0).astype("int64")
        if len(b):
            last |= sums.groupby(b.source).last().to_dict()
        yield b[["doc_id", "source", "n_tokens"]].assign(part=part, local_sum=sums.astype("int64"))


def prefix_sums(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized(doc_id, source, n_tokens)`` with each document's prefix sum in its source's random order."""
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    ranges = keyed.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    parts = materialise(ranges.select("doc_id", "source", "n_tokens").mapInPandas(_sums, SUMS))
    totals = parts.groupBy("source", "part").agg(F.max("local_sum").alias("total"))
    # one row for each range and source in it
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0))).select("source", "part", "offset")
    return parts.join(offsets, ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("local_sum")).alias("prefix"))


def sized_documents(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that can be used; written once, as it is read twice."""
    wanted = weights.where("target_share > 0 and max_repeats >= 1").select("source").distinct()
    # the list of sources is a table of settings; where it is large the join is shuffled
    used = documents.where("source is not null and length(text) > 0").join(wanted, "source", "left_semi").select("doc_id", "source", "text")
    return token_counts(used, path, "source").where("n_tokens > 0").select("doc_id", "source", "n_tokens")


def budgets(sized: DataFrame, weights: DataFrame, size: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, available, budget), one row for each listed source."""
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available"))
    listed = weights.groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    both = listed.join(have, "source", "left").fillna({"n_docs": 0, "available": 0})
    most = F.col("available") * F.greatest("max_repeats", F.lit(0))
    usable = (F.col("target_share") > 0) & (F.col("available") > 0) & (F.col("max_repeats") >= 1)
    # the settings table is one row for each listed source
    whole = Window.partitionBy(F.lit(0))
    total = F.min(F.when(usable, most / F.col("target_share"))).over(whole) if size is None else F.lit(float(size))
    budget = F.when(usable, F.least(F.floor(F.col("size") * F.col("target_share") + 1e-6), most)).otherwise(F.lit(0)).cast("long")
    return both.withColumn("size", total).withColumn("budget", budget).drop("size")


def mix(sized: DataFrame, weights: DataFrame, size: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mixture."""
    plan = budgets(sized, weights, size).where("budget > 0").select("source", "budget", "available", "max_repeats")
    rows = prefix_sums(sized, seed).join(plan, "source")
    full = F.floor(F.col("budget") / F.col("available"))
    left = F.col("budget") - full * F.col("available")
    # the document across the cut is used if that comes nearer to the budget
    more = (F.col("prefix") <= left) | ((F.col("prefix") - F.col("n_tokens") < left) & (F.col("prefix") - left < left - (F.col("prefix") - F.col("n_tokens"))))
    copies = F.least(full + F.when(more & (left > 0), 1).otherwise(0), F.col("max_repeats")).cast("int")
    return rows.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weights = table(spark, sf_dir, "source_weights").select("source", "target_share", "max_repeats")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return materialise(sized_documents(documents, weights)), weights


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, weights = inputs(spark, sf_dir)
    return mix(sized, weights)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every listed source."""
    sized, weights = inputs(spark, sf_dir)
    used = mix(sized, weights).groupBy("source").agg(
        F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies")
    )
    plan = budgets(sized, weights)
    rows = plan.join(used, "source", "left").fillna({"docs_used": 0, "tokens_used": 0, "most_copies": 0})
    rows = rows.withColumn("total", F.sum("tokens_used").over(Window.partitionBy(F.lit(0))))
    share = F.when(F.col("total") > 0, F.col("tokens_used") / F.col("total")).otherwise(F.lit(0.0))
    return rows.select(
        "source", "target_share", "max_repeats", "n_docs", "available", "budget", "docs_used", "tokens_used", "most_copies", share.alias("reached_share")
    )
