"""Registered queries of what writes files and reads them back: images, points, metadata, cluster documents.

Each writes to a folder of its own below the shared folder, which goes when the driver's JVM ends. Images
are made from the points: image n is one colour, n modulo 251, and every eleventh one is unreadable.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, vectors
from ..operators import documents, ingest, metrics
from ..sources import files
from ..sources.points import FACE_DIMENSION, REID_DIMENSION, checked, points, table, tiled
from ..storage import forget_later, shared_dir
from . import pipelines
from .catalogue import EPS, K, LABELS, MIN_SAMPLES, POINTS, ROUNDS, _experiments, _labels, _lloyd, experiments_sql, query


def _folder(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget_later(spark, path)
    return path


# -- images ---------------------------------------------------------------------------------------

IMAGES = (
    "images AS (SELECT *, n % 251 AS v, 1 + n % 3 AS w, 1 + n % 4 AS h, n % 11 <> 10 AS good FROM "
    "(SELECT DISTINCT vec_id // 4 AS n, 'img_' || (vec_id // 4) || '.jpg' AS name FROM embeddings)), "
    "crops AS (SELECT name, v, unnest(range(1, 1 + v % 4)) AS no FROM images WHERE good)"
)


def _image_folder(spark, sf_dir) -> str:
    """A folder with the images of the points as binary PPM, and text files among them."""
    n = F.col("n")
    width, height, colour = 1 + n % 3, 1 + n % 4, F.format_string("%02x", n % 251)
    head = F.encode(F.format_string("P6\n%d %d\n255\n", width, height), "utf-8")
    pixels = F.unhex(F.repeat(colour, (3 * width * height).cast("int")))
    content = F.when(n % 11 == 10, F.encode(F.lit("broken"), "utf-8")).otherwise(F.concat(head, pixels))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("n")).distinct()
    pictures = rows.select(F.format_string("img_%d.jpg", n).alias("crop_name"), content.alias("crop"))
    notes = rows.where("n % 5 = 0").select(F.format_string("note_%d.txt", n).alias("crop_name"), F.encode(F.lit("text"), "utf-8").alias("crop"))
    folder = _folder(spark, "images")
    ingest.write_crops(pictures.unionByName(notes), folder)
    return folder


def _detector():
    """Finds colour modulo 4 persons; crop ``no`` is one pixel of (colour, no, 0)."""

    def detect(content: bytes) -> list[tuple[bytes, float]]:
        v = int(ingest.decoded(content)[0, 0, 0])
        return [(b"P6\n1 1\n255\n" + bytes([v, no, 0]), 0.5 + no / 10) for no in range(1, 1 + v % 4)]

    return detect


def _body_encoder():
    def encode(content: bytes, camera: int) -> np.ndarray:
        return np.resize(ingest.decoded(content)[0, 0].astype(float), REID_DIMENSION)

    return encode


def _face_detector():
    """(colour + no) modulo 3 faces, of scores 0.4 and 0.6."""

    def detect(content: bytes) -> list[dict]:
        v, no, _ = (int(x) for x in ingest.decoded(content)[0, 0])
        return [{"bbox": (0, 0, 1, 1), "embedding": np.ones(FACE_DIMENSION), "det_score": 0.4 + 0.2 * f, "age": v, "gender": "F"} for f in range((v + no) % 3)]

    return detect


def _mean_encoder():
    """The mean of each colour of the preprocessed image."""
    return lambda content, camera: ingest.preprocessed(ingest.decoded(content)).mean((1, 2))


@query(f"WITH {IMAGES} SELECT name, CASE WHEN good THEN 11 + 3 * w * h ELSE 6 END AS length FROM images")
def image_dir_scan(spark, sf_dir):
    return files.images(spark, _image_folder(spark, sf_dir), with_content=False).select(names.base_name(F.col("path")).alias("name"), "length")


@query(f"WITH {IMAGES} SELECT name, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN good THEN round((v / 255.0::DOUBLE - 0.5) / 0.5, 6) END AS level FROM images")
def image_encode(spark, sf_dir):
    """Decode, resize and normalise every image; unreadable ones are failed rows."""
    rows = ingest.encode_images(files.images(spark, _image_folder(spark, sf_dir)), _mean_encoder, 3)
    return rows.select(names.base_name(F.col("path")).alias("name"), "status", F.round(F.col("vector")[1], 6).alias("level"))


def _built(spark, sf_dir) -> tuple[DataFrame, str]:
    path = _folder(spark, "points")
    load = (_detector, _body_encoder, REID_DIMENSION, "market1501")
    return pipelines.build_points(spark, _image_folder(spark, sf_dir), path, *load, reset=True, load_face=_face_detector), path


@query(
    f"WITH {IMAGES} SELECT count(*) AS found, CAST(count_if(good AND v % 4 > 0) AS BIGINT) AS processed, CAST(count_if(NOT good) AS BIGINT) AS failed, "
    "CAST(count_if(good AND v % 4 = 0) AS BIGINT) AS no_person, (SELECT count(*) FROM crops) AS persons, "
    "(SELECT count(*) FROM crops WHERE (v + no) % 3 = 2) AS faces FROM images"
)
def build_counters(spark, sf_dir):
    """Counters of a whole run from images to points."""
    return _built(spark, sf_dir)[0]


@query(
    f"WITH {IMAGES} SELECT name AS original, name || '_person_' || no || '.jpg' AS crop_filename, (v + no) % 3 = 2 AS face_detected, "
    "CASE WHEN (v + no) % 3 = 2 THEN 0.6::DOUBLE END AS face_score, CAST(CASE WHEN (v + no) % 3 = 2 THEN v END AS INTEGER) AS face_age, "
    "v::DOUBLE AS first, no::DOUBLE AS second FROM crops"
)
def built_points(spark, sf_dir):
    """The points that a whole run wrote: persons with the best face of each."""
    rows = spark.read.parquet(_built(spark, sf_dir)[1])
    return rows.select(
        names.base_name(F.col("original_image")).alias("original"), "crop_filename", "face_detected", F.round("face_detection_score", 6).alias("face_score"),
        "face_age", F.col("reid")[0].alias("first"), F.col("reid")[1].alias("second"),
    )


@query(
    f"WITH {IMAGES} SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY n % 6 ORDER BY name) AS k FROM images) WHERE k <= 3"
)
def sample_copy(spark, sf_dir):
    """Copy the first three images of each of six groups to a folder, and list it."""
    found = files.images(spark, _image_folder(spark, sf_dir), with_content=False)
    grouped = found.select("path", (F.regexp_extract("path", r"img_(\d+)\.jpg$", 1).cast("long") % 6).alias("part"))
    folder = _folder(spark, "sample")
    ingest.copy_sample(ingest.first_per_group(grouped, "part", "path", 3), folder)
    return files.images(spark, folder, with_content=False).select(names.base_name(F.col("path")).alias("name"))


# -- points, metadata, documents ------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT point_id, round(list_sum(reid), 6) AS total FROM points")
def points_round_trip(spark, sf_dir):
    """Append points twice, reset, and read: the reset leaves one row each."""
    path, rows = _folder(spark, "points"), points(spark, sf_dir).select("point_id", "reid")
    for reset in (False, False, True):
        ingest.write_points(rows, path, reset, "reid", REID_DIMENSION)
    total = F.aggregate("reid", F.lit(0.0), lambda s, x: s + x)
    return checked(spark.read.parquet(path), "reid", REID_DIMENSION).select("point_id", F.round(total, 6).alias("total"))


METADATA = "point_id long, source string, crop_path string, filename string, face_detected boolean, market_id int, camera_id int"


@query(f"WITH {POINTS} SELECT point_id, source, 'crops/' || filename AS crop_path, filename, face IS NOT NULL AS face_detected, market_id, camera_id FROM points")
def metadata_round_trip(spark, sf_dir):
    path = _folder(spark, "metadata")
    ingest.write_metadata(points(spark, sf_dir), path)
    return files.json_documents(spark, path, METADATA, lines=True)


@query("SELECT 'tuning_b' AS found, true AS missing_is_none, true AS required_raises")
def tuning_probe(spark, sf_dir):
    """The first of several files that is there; a missing one is None, or raises if it is required."""
    folder = _folder(spark, "probe")
    for name in ("tuning_b", "tuning_c"):
        spark.range(1).write.json(f"{folder}/{name}")
    found = files.first_existing(spark, folder, ["tuning_a", "tuning_b", "tuning_c"])
    none = files.json_documents(spark, f"{folder}/tuning_a", required=False) is None
    try:
        files.json_documents(spark, f"{folder}/tuning_a")
        raises = False
    except FileNotFoundError:
        raises = True
    row = (found.rpartition("/")[2], none, raises)
    return spark.createDataFrame([row], "found string, missing_is_none boolean, required_raises boolean")


def _saved_sql() -> str:
    lloyd = _lloyd()
    steps = lloyd[lloyd.index("c0 AS") : lloyd.rindex(" SELECT point_id, c AS")]
    part = "SELECT '{0}' AS algorithm, {1} AS cluster_id, count(*) AS size, min(point_id) AS first_point, max(point_id) AS last_point FROM {2} GROUP BY {1}"
    return f"{LABELS}, {steps} " + part.format("dbscan", "cluster_id", "labels") + " UNION ALL " + part.format("kmeans", "c", f"a{ROUNDS}")


@query(_saved_sql())
def saved_clusters(spark, sf_dir):
    """Cluster documents that a run of two methods saved, read back."""
    folder = _folder(spark, "clusters")
    methods = {"dbscan": {"method": "dbscan", "eps": EPS, "min_samples": MIN_SAMPLES}, "kmeans": {"method": "kmeans", "k": K, "rounds": ROUNDS}}
    pipelines.cluster_all(points(spark, sf_dir), methods, folder)
    out = None
    for name in methods:
        saved = files.json_documents(spark, f"{folder}/{name}/clusters", "cluster_id int, size long, members string", lines=True)
        ids = F.transform(F.from_json("members", "array<struct<point_id: long>>"), lambda m: m["point_id"])
        row = saved.select(F.lit(name).alias("algorithm"), "cluster_id", "size", F.array_min(ids).alias("first_point"), F.array_max(ids).alias("last_point"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {POINTS} SELECT point_id, round(CASE WHEN point_id % 4 = 0 THEN 0.5 WHEN point_id % 4 = 1 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS purity FROM points")
def metric_fallback(spark, sf_dir):
    """A metric of a row itself, else of its evaluation, else 0."""
    i = F.col("point_id") % 4
    rows = points(spark, sf_dir).select("point_id", F.when(i == 0, 0.5).alias("purity"), F.struct(F.when(i < 2, 0.25).alias("purity")).alias("evaluation"))
    return rows.select("point_id", documents.metric_or(rows, "purity").alias("purity"))


# -- vectors, samples, rankings -------------------------------------------------------------------


@query(
    f"WITH {POINTS} SELECT point_id, CASE WHEN point_id % 7 = 0 THEN 0.0 ELSE round(reid[1] / sqrt(list_dot_product(reid, reid)), 6) END AS first, "
    "CASE WHEN point_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM points"
)
def l2_normalize_guarded(spark, sf_dir):
    """Vectors of length 1; a zero vector, as every seventh is made here, stays zero."""
    zero = F.array_repeat(F.lit(0.0), REID_DIMENSION)
    rows = points(spark, sf_dir).select("point_id", F.when(F.col("point_id") % 7 == 0, zero).otherwise(F.col("reid")).alias("v"))
    unit = rows.select("point_id", vectors.l2_normalize_guarded(F.col("v")).alias("u"))
    return unit.select("point_id", F.round(F.col("u")[0], 6).alias("first"), F.round(vectors.norm(F.col("u")), 6).alias("length"))


TILES = 5_000


@query(
    f"WITH {POINTS} SELECT point_id + copy * {1 << 40} AS point_id, source FROM points, "
    f"(SELECT unnest(range(CAST(ceil({TILES} / (SELECT greatest(1, count(*)) FROM embeddings)) AS BIGINT))) AS copy) ORDER BY 1 LIMIT {TILES}"
)
def tile_points(spark, sf_dir):
    """Points repeated under new ids until there are 5,000, as the search at scale takes them."""
    return tiled(points(spark, sf_dir).select("point_id", "source"), TILES)


@query(f"{LABELS} SELECT cluster_id, count(*) AS size FROM labels GROUP BY cluster_id ORDER BY cluster_id LIMIT 20")
def first_clusters(spark, sf_dir):
    return metrics.top_clusters(_labels(spark, sf_dir), by_size=False)


@query(experiments_sql("SELECT CAST(row_number() OVER (ORDER BY ari DESC, nmi DESC, purity DESC, experiment) AS INTEGER) AS rank, experiment, purity, ari, nmi FROM r"))
def ranked_experiments(spark, sf_dir):
    """The experiments of the sweep, best first."""
    best = pipelines.ranked_experiments(_experiments(spark, sf_dir))
    order = Window.orderBy(F.desc("ari"), F.desc("nmi"), F.desc("purity"), "experiment")  # a row for each experiment
    return best.select(F.row_number().over(order).alias("rank"), "experiment", "purity", "ari", "nmi")
