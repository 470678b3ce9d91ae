"""Reading, counting keys once, intermediate tables, and running values without single-task groups."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of at most this many rows of a few numbers may be broadcast; its rows are counted first.
MOST_BROADCAST = 1_000_000
#: Rows of one key that a single task may sort.
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key; a key delivered again has the same values but for ``ingested_at``."""
    return df.dropDuplicates(list(keys))


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``MOST_BROADCAST`` rows; else it is left to be shuffled."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def once_of(spark: SparkSession, sf_dir: str, name: str, keys: list[str], columns: list[str | Column], where: str | Column | None = None) -> DataFrame:
    """Keys and columns of a table with each key once, for wide columns: only the keys are shuffled.

    A row is known by its file and its place in it.  Of the few keys that are delivered more than once a table says
    which row stays; it is broadcast if its counted size allows, and meets the rows in a shuffled join if not.
    """
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    raw = raw.withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    if where is not None:
        raw = raw.where(where)
    twice = raw.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_row").alias("_kept")).where("n > 1").drop("n")
    twice = small(materialise(twice.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_kept")))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return raw.join(twice, same, "left").where("_kept is null or _kept = _row").select(*keys, *columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session without one gets a folder of its own.

    A cluster without a shared folder is an error, as executors couldn't read each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and known.isDefined():
        at = known.get()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "bookloom-checkpoints")
    return at.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again.

    It survives the loss of executors and is used more than once without being computed again.  The folder
    belongs to one call and is deleted when the application ends.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/bookloom/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def has_hot_key(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key has more rows than one task should sort: a combined count of the key columns alone."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).limit(1).count() > 0


def running(df: DataFrame, keys: list[str], order: list[str], hot: bool | None = None, **values) -> DataFrame:
    """Running values of ``values``: name=(column, 'sum' | 'max' | 'count' | 'last' | 'lag' | 'before').

    Where no key has more than ``HOT_ROWS`` rows (counted first, unless ``hot`` tells), a window for each key does it.
    Otherwise rows are sorted by range on keys and order, so that a key with a third of all rows is spread over as many
    ranges as it needs; values run within each range, and what earlier ranges of the same key end with is added from a
    table with one row for each key and range.  Both give the same rows.

    Order columns must tell rows of a key apart.  Nulls don't change a running value; before the first value it is null
    (count: 0).  'lag' is the value of the row before, null in a key's first row; 'before' is the last value of the
    rows before.
    """
    if hot if hot is not None else has_hot_key(df, keys):
        return _running_by_range(df, keys, order, values)
    each = Window.partitionBy(*keys).orderBy(*order)
    so_far, earlier = each.rowsBetween(Window.unboundedPreceding, 0), each.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {
        "sum": lambda c: F.sum(c).over(so_far), "max": lambda c: F.max(c).over(so_far), "count": lambda c: F.count(c).over(so_far),
        "last": lambda c: F.last(c, ignorenulls=True).over(so_far), "before": lambda c: F.last(c, ignorenulls=True).over(earlier), "lag": lambda c: F.lag(c).over(each),
    }
    return df.withColumns({name: kinds[kind](column) for name, (column, kind) in values.items()})


def _running_by_range(df: DataFrame, keys: list[str], order: list[str], values: dict) -> DataFrame:
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = inside.rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": F.sum, "max": F.max, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    for name, (column, kind) in values.items():
        if kind == "lag":
            ranged = ranged.withColumn(f"_{name}", F.lag(column).over(inside)).withColumn(f"_{name}_first", F.row_number().over(inside) == 1)
        elif kind == "before":
            ranged = ranged.withColumn(f"_{name}", F.last(column, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        else:
            ranged = ranged.withColumn(f"_{name}", kinds[kind](column).over(local))
    last = F.struct(*order)
    at = [
        F.max_by(column, F.when(F.col(column).isNotNull(), last) if kind == "before" else last).alias(f"_{name}_end") if kind in ("lag", "before") else F.max_by(f"_{name}", last).alias(f"_{name}_end")
        for name, (column, kind) in values.items()
    ]
    ends = ranged.groupBy(*keys, "_part").agg(*at)
    ranges = Window.partitionBy(*keys).orderBy("_part")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    for name, (_, kind) in values.items():
        carry = {"sum": F.sum, "count": F.sum, "max": F.max, "last": kinds["last"], "before": kinds["last"]}
        ends = ends.withColumn(f"_{name}_before", F.lag(f"_{name}_end").over(ranges) if kind == "lag" else carry[kind](f"_{name}_end").over(before))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], *[f"_{n}_before" for n in values])
    same = F.lit(True)
    for i, k in enumerate([*keys, "_part"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = ranged.join(ends, same)
    drop = ["_part", *[f"_k{i}" for i in range(len(keys) + 1)]]
    for name, (_, kind) in values.items():
        here, earlier = F.col(f"_{name}"), F.col(f"_{name}_before")
        if kind == "lag":
            both = F.when(F.col(f"_{name}_first"), earlier).otherwise(here)
            drop.append(f"_{name}_first")
        else:
            both = {
                "sum": F.when(here.isNull(), earlier).otherwise(here + F.coalesce(earlier, F.lit(0))),
                "count": here + F.coalesce(earlier, F.lit(0)),
                "max": F.greatest(here, earlier),
                "last": F.coalesce(here, earlier),
                "before": F.coalesce(here, earlier),
            }[kind]
        out = out.withColumn(name, both)
        drop += [f"_{name}", f"_{name}_before"]
    return out.drop(*drop)
