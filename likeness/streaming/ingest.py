"""Continuous ingest of points: micro-batches upserted into a table of versioned parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def point_stream(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch with its number as version; a repeated batch overwrites its own part."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_points(spark: SparkSession, path: str, key: str = "point_id") -> DataFrame:
    """The newest version of every point."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    return spark.read.parquet(path).withColumn("_n", last).where("_n = 1").drop("_n", "version")
