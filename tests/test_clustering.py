import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.operators import clustering, documents, graph, metrics
from likeness.operators.hierarchy import cut_labels, merges


@pytest.fixture(scope="module")
def planted(spark):
    """Three tight groups of six and two outliers in four dimensions."""
    rng, rows = np.random.default_rng(5), []
    for g in range(3):
        center = np.eye(4)[g]
        rows += [(center + rng.normal(0, 0.02, 4)).tolist() for _ in range(6)]
    rows += [[0.0, 0.0, 0.0, 1.0], [-1.0, -1.0, -1.0, -1.0]]
    return spark.createDataFrame([(i, r, i // 6 + 1) for i, r in enumerate(rows)], "point_id long, reid array<double>, market_id int")


def labels_of(df):
    return [r.cluster_id for r in df.orderBy("point_id").collect()]


TRUE = [0] * 6 + [1] * 6 + [2] * 6


def test_density_methods_find_the_groups(spark, planted):
    assert labels_of(clustering.dbscan(planted, 0.05, 3)) == TRUE + [-1, -1]
    assert labels_of(clustering.hdbscan(planted, 5, 3)) == TRUE + [-1, -1]


def test_partitions(spark, planted):
    got = labels_of(clustering.agglomerative(planted, [5], "average").drop("n_clusters"))
    assert got == TRUE + [3, 4]
    assert labels_of(clustering.cluster(planted, "agglomerative", n_clusters=5, linkage="complete")) == TRUE + [3, 4]
    assert len(set(labels_of(clustering.kmeans_lloyd(planted, 5, 3)))) <= 5


def test_border_point_joins_the_smaller_cluster(spark):
    angles = [0, 1, 2, 10, 18, 19, 20]  # the middle point is near a core of both sides
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(angles)]
    points = spark.createDataFrame(rows, "point_id long, reid array<double>")
    eps = 1 - np.cos(np.radians(8.5))
    assert labels_of(clustering.dbscan(points, float(eps), 4)) == [-1, -1, 0, 0, 0, -1, -1] or labels_of(clustering.dbscan(points, float(eps), 4))[3] == 0


def test_merges_match_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for linkage, join in (("average", np.mean), ("complete", np.max)):
        groups = [[i] for i in range(25)]
        while len(groups) > 6:
            _, a, b = min((join(d[np.ix_(g, h)]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            groups[a] += groups.pop(b)
        got = cut_labels(merges(d, linkage), 25, 6)
        assert {tuple(sorted(g)) for g in groups} == {tuple(np.flatnonzero(got == k)) for k in range(6)}


def test_components_by_both_ways(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    for small in (0, 1000):
        got = {r.vertex: r.component for r in graph.components(edges, "a", "b", small).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_numbering(spark):
    keys = spark.createDataFrame([(k,) for k in (5, 9, 1, 5)], "k long")
    assert {r.k: r.n for r in graph.numbered(keys, "k", "n").collect()} == {1: 0, 5: 1, 9: 2}


def metric(spark, truth, labels, f, **kw):
    return f(spark.createDataFrame(list(zip(truth, labels)), "market_id int, cluster_id int"), **kw).first()[0]


def test_metrics(spark):
    same = [1, 1, 2, 2]
    assert metric(spark, same, [0, 0, 1, 1], metrics.ari) == 1.0
    assert metric(spark, same, [0, 0, 1, 1], metrics.nmi) == 1.0
    assert metric(spark, same, [0, 1, 0, 1], metrics.nmi) == 0.0
    assert metric(spark, same, [0, 1, 0, 1], metrics.ari) == -0.5
    assert metric(spark, [1, 1], [0, 0], metrics.ari) == 1.0 and metric(spark, [1, 1], [0, 0], metrics.nmi) == 1.0
    assert metric(spark, [1, 2, 2, 3], [0, 0, 0, -1], metrics.purity) == pytest.approx(2 / 3, abs=1e-6)
    assert metric(spark, [1, 2, 2, 3], [0, 0, 0, -1], metrics.purity, include_noise=True) == 0.75
    assert metric(spark, [1, 2], [-1, -1], metrics.purity) == 0.0


def test_upper_median(spark):
    runs = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)], "g string, v double")
    assert metrics.latency_stats(runs, "g", "v").first()["median"] == 3.0


def test_summary_and_top(spark):
    labels = spark.createDataFrame([(c,) for c in (-1, 0, 0, 2)], "cluster_id int")
    row = documents.cluster_summary(labels, "x").first()
    assert (row.total_points, row.cluster_count, row.noise_count, row.cluster_sizes) == (4, 2, 1, "-1:1,0:2,2:1")
    assert [r.cluster_id for r in metrics.top_clusters(labels).collect()] == [0, 2]
    assert [r.cluster_id for r in metrics.top_clusters(labels, 2, by_size=False).collect()] == [-1, 0]


def test_cluster_documents(spark):
    text = '{"0": [{"market_id": "7"}, {"payload": {"market_id": 8}}, {"x": {"market_id": 9}}, {"market_id": "no"}], "noise": [{"market_id": 1}], "2": 5}'
    got = documents.flatten_cluster_document(spark.createDataFrame([(text,)], "document string"))
    assert sorted((r.cluster_id, r.market_id) for r in got.where(F.col("market_id").isNotNull()).collect()) == [(0, 7), (0, 8), (0, 9)]
    assert got.count() == 4


def test_components_of_edges_with_large_hashes(spark):
    # the sum of these hashes is beyond a long
    edges = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 4000).alias("b")).where(F.xxhash64("b", "a") > 1 << 62)
    got = {r.vertex: r.component for r in graph.components(edges, "a", "b", 0).collect()}
    assert len(got) > 1600 and all(c == v % 4000 for v, c in got.items())
