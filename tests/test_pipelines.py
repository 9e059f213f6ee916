import json

import pytest
from pyspark.sql import functions as F

from likeness.operators import documents, ingest, search
from likeness.plans import pipelines
from likeness.sources import files
from likeness.sources.points import tiled

SCHEMA = "point_id long, reid array<double>, market_id int, camera_id int, original_image string, crop_path string, crop_filename string, dataset string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, [1.0, i / 10, float(i // 4)], i // 4 + 1, i % 2, f"i{i}", f"c{i}", f"c{i}.jpg", "d") for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def test_build_points_counts_every_image(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for name, body in (("a.jpg", b"two"), ("b.JPG", b"none"), ("c.png", b"bad"), ("d.txt", b"two")):
        (folder / name).write_bytes(body)

    def load_detector():
        def detect(image):
            if image == b"bad":
                raise ValueError("cannot be read")
            return [(b"x", 0.9), (b"y", 0.8)] if image == b"two" else []

        return detect

    out = str(tmp_path / "points")
    for _ in range(2):  # the second run replaces the same points
        got = pipelines.build_points(spark, str(folder), out, load_detector, lambda: ingest.stub_encoder(8), 8, "sample", reset=True)
        assert tuple(got.first()) == (3, 1, 1, 1, 2, 0)
    rows = spark.read.parquet(out)
    assert rows.count() == 2 and rows.select("point_id").distinct().count() == 2


def test_what_is_built_can_be_searched_and_clustered(spark, tmp_path):
    folder, out = tmp_path / "images", str(tmp_path / "points")
    folder.mkdir()
    for n in range(4):
        (folder / f"i{n}.jpg").write_bytes(f"image {n}".encode())

    def load_detector():
        return lambda image: [(image + b" left", 0.9), (image + b" right", 0.8)]

    def load_face():
        def detect(crop):
            if crop.endswith(b"right"):
                raise ValueError("no face model likes this")
            weak = {"bbox": [0.0, 1.7, 2.2, 3.0], "embedding": [9.0, 0.0, 0.0, 0.0], "det_score": 0.4}
            first = {"bbox": [1.0, 2.0, 3.9, 4.0], "embedding": [0.0, 3.0, 0.0, float(crop[6:7])], "det_score": 0.9, "age": 30, "gender": "F"}
            return [weak, first, {**first, "embedding": [1.0, 1.0, 1.0, 1.0], "age": None}]

        return detect

    got = pipelines.build_points(spark, str(folder), out, load_detector, lambda: ingest.stub_encoder(8), 8, "sample", True, load_face)
    assert tuple(got.first()) == (4, 4, 0, 0, 8, 4)
    points = spark.read.parquet(out)
    faces = points.where("face_detected").orderBy("original_image").collect()
    assert len(faces) == 4 and all(r.face_bbox == [1, 2, 3, 4] and r.face_age == 30 and abs(sum(x * x for x in r.face) - 1) < 1e-9 for r in faces)
    mine = faces[2]
    hits = search.fusion_search(points, search.vector_of(points, mine.point_id, "reid"), search.vector_of(points, mine.point_id, "face"), k=3).collect()
    assert hits[0].point_id == mine.point_id and hits[0].face_similarity == 1.0 and hits[0].face_status == "ranked"
    from likeness.operators import clustering

    assert clustering.dbscan(points, 0.5, 2).count() == clustering.hdbscan(points, 2, 2).count() == 8
    ingest.write_metadata(points, str(tmp_path / "metadata"))
    kept = spark.read.json(str(tmp_path / "metadata"))
    assert kept.count() == 8 and "reid" not in kept.columns and "face_gender" in kept.columns


def test_crops_and_samples_are_files(spark, tmp_path):
    source, target = str(tmp_path / "crops"), tmp_path / "sample"
    target.mkdir()
    (target / "old").write_text("x")
    ingest.write_crops(spark.createDataFrame([(f"c{i}.jpg", bytes([i] * 3)) for i in range(5)], "crop_name string, crop binary").repartition(2), source)
    sample = spark.createDataFrame([(f"{source}/c{i}.jpg",) for i in (1, 3)], "path string")
    assert ingest.copy_sample(sample, str(target)) == 2
    assert {p.name: p.read_bytes() for p in target.iterdir() if not p.name.endswith(".crc")} == {"c1.jpg": b"\1\1\1", "c3.jpg": b"\3\3\3"}


def test_decoding_and_preprocessing():
    import numpy as np

    pixels = np.arange(2 * 4 * 3, dtype=np.uint8).reshape(2, 4, 3) * 10
    image = ingest.decoded(b"P6\n4 2\n255\n" + pixels.tobytes())
    assert (image == pixels).all()
    drawn = ingest.decoded(ingest.annotated(np.zeros((6, 9, 3), np.uint8), [(-2, 1, 4, 5)], 1))
    assert (drawn[:, :, 1] > 0).astype(int).tolist() == [[0] * 9, [1, 1, 1, 1] + [0] * 5, [1, 0, 0, 1] + [0] * 5, [1, 0, 0, 1] + [0] * 5, [1, 1, 1, 1] + [0] * 5, [0] * 9]
    x = ingest.preprocessed(image)
    assert x.shape == (3, 256, 128) and abs(x[0, 0, 0] - (0 / 255 - 0.5) / 0.5) < 1e-9 and abs(x[2, -1, -1] - (230 / 255 - 0.5) / 0.5) < 1e-9
    assert np.allclose(ingest.preprocessed(np.full((5, 7, 3), 51, np.uint8)), (0.2 - 0.5) / 0.5)
    with pytest.raises(ValueError, match="cannot be read"):
        ingest.decoded(b"no image at all")


def test_camera_number_reaches_the_encoder(spark):
    images = spark.createDataFrame([("a", b"x", 0), ("b", b"x", 3), ("c", b"x", None)], "path string, content binary, camera_id int")
    got = {r.path: r.vector for r in ingest.encode_images(images, lambda: ingest.stub_encoder(4), 4, "camera_id").collect()}
    assert got["a"] == got["c"] != got["b"]


def test_last_row_of_equal_keys_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "point_id long, source string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (2, "z")], "point_id long, source string").coalesce(1)
    assert sorted(map(tuple, ingest.upsert(old, new).collect())) == [(1, "a"), (2, "z"), (3, "y")]


def test_ground_truth_raises_without_identity(spark, people):
    from likeness.operators import metrics

    assert metrics.ground_truth(people).count() == 12
    for bad in (people.drop("market_id"), people.withColumn("market_id", F.when(F.col("point_id") > 3, F.col("market_id")))):
        with pytest.raises(Exception, match="no market_id"):
            metrics.ground_truth(bad).collect()


def test_no_local_folder_for_a_cluster():
    from types import SimpleNamespace

    from likeness.storage import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_search_document(people):
    doc = json.loads(pipelines.search_document(people, 3, k=4).first()["document"])
    assert doc["result_count"] == 4 and [h["rank"] for h in doc["results"]] == [1, 2, 3, 4]
    first = doc["results"][0]
    assert first["embedding_id"] == 3 and first["similarity"] == 1.0 and first["crop_name"] == "c3.jpg"
    assert [h["rank_score"] for h in doc["results"]] == [1.0, 0.5, 0.3333, 0.25]


def test_cluster_all_saves_and_compares(spark, people, tmp_path):
    folder = str(tmp_path / "runs")
    got = pipelines.cluster_all(people, {"km": {"method": "kmeans", "k": 3, "rounds": 3}, "ag": {"method": "agglomerative", "n_clusters": 3, "linkage": "average"}}, folder)
    best = pipelines.ranked_experiments(got).first()
    assert best["algorithm"] == "ag" and best["cluster_count"] == 3 and best["ari"] == 1.0
    assert spark.read.json(f"{folder}/ag/summary").first()["total_points"] == 12
    assert spark.read.json(f"{folder}/ag/clusters").count() == 3
    assert spark.read.parquet(f"{folder}/experiments").count() == 2


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.json_documents(spark, str(tmp_path / "m.json"), "a long").count() == 2
    assert files.json_documents(spark, str(tmp_path / "no.json"), required=False) is None
    with pytest.raises(FileNotFoundError):
        files.json_documents(spark, str(tmp_path / "no.json"))
    assert files.first_existing(spark, str(tmp_path), ["x.json", "m.json"]).endswith("m.json")


def test_report(people):
    assert "point_id" in documents.report("People", people, 3) and "only showing top 3 rows" in documents.report("People", people, 3)


def test_metric_fallback_and_tiles(spark, people):
    rows = spark.sql("SELECT named_struct('ari', 0.5) AS evaluation, 0.25 AS nmi")
    got = rows.select(*[documents.metric_or(rows, k, -1.0).cast("double").alias(k) for k in ("ari", "nmi", "purity")]).first()
    assert tuple(got) == (0.5, 0.25, -1.0)
    many = tiled(people, 30)
    assert many.count() == 30 and many.select("point_id").distinct().count() == 30
    assert search.top_k(many, [1.0, 0.0, 0.0], "reid", 3).select(F.max("rank")).first()[0] == 3
    assert documents.sizes_map(people.select(F.col("market_id").alias("cluster_id"))).first()[0] == {"1": 4, "2": 4, "3": 4}


def test_images_whose_pixels_are_white_space_or_whose_head_has_a_comment():
    for pixels in (b" " * 12, b"\n" * 12, b"\x00 \n" * 4):
        assert ingest.decoded(b"P6\n2 2\n255\n" + pixels).tobytes() == pixels
    assert ingest.decoded(b"P6\n# made by hand\n1 1\n255\nabc").shape == (1, 1, 3)
    with pytest.raises(ValueError):
        ingest.decoded(b"P6\n2 2\n255\n" + b"x" * 11)


def test_crops_go_to_the_shared_folder_on_a_cluster(spark, tmp_path, monkeypatch):
    from likeness.storage import shared_dir

    crops = spark.createDataFrame([("a.jpg", b"\1\2")], "crop_name string, crop binary")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for k, prefix in enumerate(("", "file:", "file://")):
        folder = f"{shared_dir(spark)}/crops-{k}"
        ingest.write_crops(crops, prefix + folder)
        with open(f"{folder}/a.jpg", "rb") as f:
            assert f.read() == b"\1\2"
    for other in (str(tmp_path / "own"), f"{shared_dir(spark)}/../own", f"{shared_dir(spark)}-2"):
        with pytest.raises(ValueError, match="not shared"):
            ingest.write_crops(crops, other)
