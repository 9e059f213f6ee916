"""File sources: images, metadata documents, saved vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import is_image


def images(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """path, length and content of the image files of a folder, ordered by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = rows.where(is_image(F.col("path"))).select("path", "length", *(["content"] if with_content else []))
    return rows.orderBy("path")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_documents(spark: SparkSession, path: str, schema: StructType | str | None = None, required: bool = True, lines: bool = False) -> DataFrame | None:
    """JSON documents, a whole file or a line each; a missing file raises if required, else gives None."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return None
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    """The first of the file names that is in the folder."""
    return next((f"{folder}/{n}" for n in names if exists(spark, f"{folder}/{n}")), None)


def collection_stats(points: DataFrame, name: str) -> DataFrame:
    """One row: points, vectors of each signal, sources."""
    return points.agg(
        F.lit(name).alias("collection"),
        F.count("*").alias("points_count"),
        F.count("reid").alias("reid_count"),
        F.count("face").alias("face_count"),
        F.countDistinct("source").alias("source_count"),
    )
