"""Every query with SQL against DuckDB on the smallest tables; streams against their batch twins."""

import glob
import math
import os

import duckdb
import pytest

from bookloom.plans import catalogue
from bookloom.streaming import jobs as J

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(map(norm, r)) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query(spark, db, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(db.sql(catalogue.oracles()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def test_stream_equals_batch(spark, tmp_path):
    batch = J.latest_state(spark.read.parquet(f"{SF}/events.parquet")).toPandas()
    os.makedirs(tmp_path / "in")
    os.symlink(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = J.streamed(spark, str(tmp_path / "in"), J.latest_state)
    got = J.run_to_table(stream, "latest_state_out", checkpoint=str(tmp_path / "c")).toPandas()
    assert rows(got) == rows(batch)
    counts = J.streamed(spark, str(tmp_path / "in"), J.windowed_counts)
    got = J.run_to_table(counts, "windows_out", checkpoint=str(tmp_path / "w"))
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
