"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from likeness.plans import catalogue, storage_catalogue  # noqa: F401

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(frame, columns):
    value = lambda x: int(x) if isinstance(x, float) and x == x and x == int(x) else x
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(str([value(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_streaming_upsert(spark, tmp_path):
    from likeness.streaming.ingest import latest_points, point_stream, upsert_stream

    source, target, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    for batch in ([(1, "a"), (2, "b")], [(2, "c")]):
        spark.createDataFrame(batch, "point_id long, source string").coalesce(1).write.mode("append").parquet(source)
        upsert_stream(point_stream(spark, source, "point_id long, source string"), target, state).awaitTermination()
    assert sorted(map(tuple, latest_points(spark, target).collect())) == [(1, "a"), (2, "c")]
