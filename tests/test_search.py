import pandas as pd
import pytest
from pyspark.sql import functions as F

from likeness.operators import ingest, pairs, search

SCHEMA = "point_id long, reid array<double>, face array<double>, market_id int, camera_id int, original_image string, crop_path string"


def points(spark, rows):
    return spark.createDataFrame([(i, r, f, m, c, f"i{i}", f"c{i}") for i, r, f, m, c in rows], SCHEMA)


@pytest.fixture(scope="module")
def people(spark):
    return points(
        spark,
        [
            (1, [1.0, 0.0], [1.0, 0.0], 1, 0), (2, [0.9, 0.1], [0.0, 1.0], 1, 1), (3, [0.8, 0.3], None, 2, 0),
            (4, [-1.0, 0.0], [1.0, 0.05], 2, 1), (5, [0.0, 1.0], [-1.0, 0.0], 3, 0),
        ],
    )


def test_self_is_first_and_k_is_bounded(spark, people):
    hits = search.top_k(people, [1.0, 0.0], "reid", 50).collect()
    assert (hits[0].point_id, hits[0].rank, hits[0].similarity) == (1, 1, 1.0)
    assert [h.rank for h in hits] == [1, 2, 3, 4, 5]
    assert search.top_k(people, None, "face", 5).count() == 0


def test_fusion_cases(spark, people):
    got = {r.point_id: r for r in search.fusion_search(people, [1.0, 0.0], [1.0, 0.0], k=10, per_signal=2).collect()}
    assert got[1].face_status == "ranked" and got[1].fusion_score == 1.0
    assert got[2].face_status == "direct" and got[2].face_similarity == 0.0  # exactly 0 stays a number
    assert got[4].reid_similarity is None and got[4].face_status == "ranked"
    assert set(got) == {1, 2, 4}
    no_face = {r.point_id: r for r in search.fusion_search(people, [1.0, 0.0], None, k=10, per_signal=3).collect()}
    assert {r.face_status for r in no_face.values()} == {"query_no_face"}
    assert {r.face_status for r in search.fusion_search(people, [1.0, 0.0], [1.0, 0.0], k=10, per_signal=3).where("point_id = 3").collect()} == {"person_no_face"}


def test_candidate_sets(spark, people):
    got = {r.point_id: r.membership for r in search.candidate_sets(people, [1.0, 0.0], [1.0, 0.0], 2).collect()}
    assert got == {1: "both", 2: "reid_only", 4: "face_only"}


def test_rank1_leaves_out_queries_without_answer(spark):
    same = points(spark, [(i, [1.0, i / 100], None, 7, 0) for i in range(3)] + [(9, [-1.0, 0.0], None, 8, 1)])
    detail = search.rank1_detail(same, k=3)
    assert [r.query_id for r in detail.collect()] == [9]
    acc = search.rank1_accuracy(detail).first()
    assert (acc.evaluated, acc.correct, acc.accuracy) == (1, 0, 0.0)
    assert search.rank1_accuracy(detail.limit(0)).first().accuracy == 0.0


def test_blocks_and_broadcast_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * 7) % 11), float((i * 5) % 13), 1.0]) for i in range(60)], "id long, vector array<double>")
    want = {(r.query_id, r.id) for r in pairs.nearest(rows, rows, 4).collect()}
    near = {(r.i, r.j) for r in pairs.within_distance(rows, 0.01).collect()}
    monkeypatch.setattr(pairs, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    assert {(r.query_id, r.id) for r in pairs.nearest(rows, rows, 4).collect()} == want
    assert {(r.i, r.j) for r in pairs.within_distance(rows, 0.01).collect()} == near


def test_upsert_and_counters(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "point_id long, source string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "point_id long, source string, version int")
    assert sorted(map(tuple, ingest.upsert(old, new, "point_id", "version").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    empty = spark.createDataFrame([], "status string, persons long, faces long")
    assert tuple(ingest.etl_counters(empty).first()) == (0, 0, 0, 0, 0, 0)


def test_encoders_isolate_failures(spark):
    images = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b""))], "path string, content binary")

    def load():
        encode = ingest.stub_encoder(8)

        def guarded(image, camera):
            if not image:
                raise ValueError("empty image")
            return encode(image, camera)

        return guarded

    got = {r.path: r for r in ingest.encode_images(images, load, 8).collect()}
    assert got["a"].status == "ok" and abs(sum(x * x for x in got["a"].vector) - 1) < 1e-9
    assert got["b"].status == "failed" and "empty image" in got["b"].error


def test_best_face_takes_first_of_equals(spark):
    faces = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.2), (2, 1, 0.1)], "image_id long, face_no long, det_score double")
    assert [tuple(r) for r in ingest.best_face(faces, "image_id", 0.5).collect()] == [(1, 1, 0.9)]


def test_first_per_group(spark):
    rows = spark.createDataFrame([(1, c) for c in "dbac"], "g int, f string")
    assert sorted(r.f for r in ingest.first_per_group(rows, "g", "f", 3).collect()) == ["a", "b", "c"]
    assert ingest.sample_then_filter(rows, "f", 2, F.lit(True)).count() == 2


def test_kernels_get_steps_of_bounded_size(spark, monkeypatch):
    # 9,000 by 17,000 vectors, by the broadcast matrix and by blocks: no step has more than 32 MB of products
    rows = spark.range(17_000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))

    def kernel(q_ids, q, c_ids, c):
        return pd.DataFrame({"products": [len(q_ids) * len(c_ids)], "sum": [int(q_ids.sum()) * len(c_ids) + int(c_ids.sum()) * len(q_ids)]})

    for size in (pairs.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pairs, "BROADCAST_BYTES", size)
        found = pairs.pairwise(rows.where("id < 9000"), rows, kernel, "products long, sum long").toPandas()
        assert found["products"].max() <= 1 << 22
        assert found["products"].sum() == 9000 * 17_000
        assert found["sum"].sum() == (9000 * 8999 // 2) * 17_000 + (17_000 * 16_999 // 2) * 9000
