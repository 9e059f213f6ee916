import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns and 0 < after.count() <= seen
        docs, seen = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == seen


def test_stages_on_edge_cases_and_no_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        whole = docs.withColumn("row", docs["label"])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.stored(stage(spark, whole, DATA), name)
            assert after.schema == whole.schema and after.count() <= whole.count()
            whole = after
        packed = corpus_pipeline.STAGES[-1][1](spark, whole, DATA)
        assert packed.where("piece = 0").count() == whole.count()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_license_scan"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    got = entry.queries()[name](spark, DATA)
    order = con.sql(entry.oracle_sql()[name]).columns
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, want))
