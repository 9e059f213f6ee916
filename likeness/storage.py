"""Tables written to the folder that driver and executors share, to cut lineage safely."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Share of the driver's heap that ``ease`` lets finished jobs take.
FULL = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"likeness-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lost executor costs nothing.

    The table is deleted when the driver's JVM ends, if ``drop_stored`` has not done so before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    forget_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._likeness_path = path
    return out


def forget_later(spark: SparkSession, path: str) -> None:
    """Have a path deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop_stored(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._likeness_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver let go of what finished jobs leave: plans, shuffles and broadcasts, and the heap that they took.

    Spark does so by itself only when the driver's heap is full. The driver's Python gives its free memory back, too.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)
    spark._jvm.System.gc()


def ease(spark: SparkSession) -> bool:
    """``tidy`` if the driver's heap has grown beyond ``FULL`` of its limit, for steps that come many times."""
    runtime = spark._jvm.Runtime.getRuntime()
    grown = runtime.totalMemory() > FULL * runtime.maxMemory()
    if grown:
        tidy(spark)
    return grown
