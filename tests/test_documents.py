from pyspark.sql import functions as F

from likeness.operators import documents

CASES = [
    ('{"a": {"b": {"market_id": 3}}}', 3),
    ('{"payload": {"x": {"market_id": 3}}}', 3),
    ('{"z": {"market_id": 1}, "payload": {"p": {"q": {"market_id": "4"}}}}', 4),
    ('{"market_id": "none", "a": {"market_id": null, "b": {"c": {"market_id": 5}}}, "d": {"market_id": 6}}', 5),
    ('{"a": [{"market_id": 7}], "b": {"c": [{"market_id": 7}]}}', None),
    ('{"market_id": 0, "payload": {"market_id": 8}}', 0),
    ('{"market_id": 99999999999}', None),
    ('[{"market_id": 9}]', None),
    ("{broken", None),
    (None, None),
]


def test_key_is_found_at_any_depth(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, document string")
    got = {r.i: r.found for r in rows.select("i", documents.find_key(F.col("document"), "market_id").alias("found")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_members_of_cluster_documents_are_searched_deeply(spark):
    text = '{"1": [{"a": {"b": {"market_id": 3}}}, {"payload": {"x": {"market_id": 4}}}, {"a": [1]}]}'
    rows = documents.flatten_cluster_document(spark.createDataFrame([(text,)], "document string")).collect()
    assert sorted((r.cluster_id, r.market_id or 0) for r in rows) == [(1, 0), (1, 3), (1, 4)]
