"""Points tables: schema, checks, and deterministic adapters of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, has_dimension, require_dimension

REID_DIMENSION, FACE_DIMENSION = 64, 32

#: Columns of a points table; vectors are null where a signal is absent.
POINTS = (
    "point_id long, reid array<double>, face array<double>, source string, dataset string, split string, "
    "original_image string, crop_path string, crop_filename string, filename string, person_detection boolean, "
    "face_detected boolean, market_id int, camera_id int"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as points: a face for four of five, six cameras, two sources."""
    e = table(spark, sf_dir, "embeddings")
    name = F.format_string("%04d_c%ds%d_%06d_00.jpg", F.col("label"), F.col("vec_id") % 6 + 1, F.col("vec_id") % 3 + 1, F.col("vec_id"))
    image = F.concat(F.lit("photos/img_"), F.floor(F.col("vec_id") / 4).cast("string"), F.lit(".jpg"))
    reid = as_double(F.col("embedding"))
    return e.select(
        F.col("vec_id").alias("point_id"),
        reid.alias("reid"),
        F.when(F.col("vec_id") % 5 != 0, F.slice(reid, 1, FACE_DIMENSION)).alias("face"),
        F.when(F.col("vec_id") % 10 < 9, "market1501").otherwise("sample_photos").alias("source"),
        F.lit("market1501").alias("dataset"),
        F.lit("test").alias("split"),
        image.alias("original_image"),
        F.concat(F.lit("crops/"), name).alias("crop_path"),
        name.alias("crop_filename"),
        name.alias("filename"),
        F.lit(True).alias("person_detection"),
        (F.col("vec_id") % 5 != 0).alias("face_detected"),
        F.col("label").cast("int").alias("market_id"),
        (F.col("vec_id") % 6).cast("int").alias("camera_id"),
    )


def vectors(points_df: DataFrame, signal: str, dimension: int, source: str | None = None) -> DataFrame:
    """Points of a source that carry the signal in its dimension; others are skipped."""
    rows = points_df if source is None else points_df.where(F.col("source") == source)
    return rows.where(has_dimension(F.col(signal), dimension))


def checked(points_df: DataFrame, signal: str, dimension: int) -> DataFrame:
    """The same rows; reading raises if a vector has another dimension."""
    return points_df.withColumn(signal, require_dimension(F.col(signal), dimension))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as detection boxes on images of 640 x 480."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    x, y = i * 37 % 720 - 60, i * 53 % 560 - 60
    return e.select(
        i.alias("detection_id"),
        F.floor(i / 8).cast("long").alias("image_id"),
        F.when(F.col("event_type").isin("view", "click"), "person").otherwise(F.col("event_type")).alias("class_name"),
        ((i * 17 % 100) / 100.0).cast("double").alias("confidence"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + 40 + i * 29 % 260).cast("double").alias("x2"),
        (y + 60 + i * 31 % 300).cast("double").alias("y2"),
    )


def tiled(rows: DataFrame, n: int, id_column: str = "point_id") -> DataFrame:
    """At least the rows of a table and at most n, repeated with new ids until there are n."""
    have = max(1, rows.count())
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // have) - 1)))).alias("_copy")
    more = rows.select("*", copies)
    return more.withColumn(id_column, F.col(id_column) + F.col("_copy") * F.lit(1 << 40)).drop("_copy").orderBy(id_column).limit(n)
