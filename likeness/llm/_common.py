"""Shared plumbing of the training-data operators: code shipping, storage, row identity."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship as ship_package
from ..storage import drop_stored, ease, forget_later, shared_dir, stored, tidy  # noqa: F401

#: Text handled at once inside a Python worker; a longer single text is its own slice.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch sent to a Python worker.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_id_of(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long")


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches, most: int = SLICE_BYTES, column: int | None = None):
    """(record batch, texts) of bounded text size from the batches of ``mapInArrow``.

    A text that is longer than ``most`` is alone in its slice. ``column`` is the place of the text
    column, by default the one named ``text``.
    """
    for batch in batches:
        k = batch.schema.get_field_index("text") if column is None else column
        sizes = batch.column(k)
        if not batch.num_rows:
            continue
        lengths = [0 if n is None else n for n in pa.compute.binary_length(sizes).to_pylist()]
        start, size = 0, 0
        for i, n in enumerate([*lengths, None]):
            if n is None or (i > start and size + n > most):
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(k).to_pylist()]
                start, size = i, 0
            size += n or 0
