"""Token ids in Parquet files: ordered rows, list columns, dictionary encoding, page indexes.

Documents are ordered by doc_id, null ids first, and those of one id by a hash of the text, over a
range-partitioned set of files; the hash lets the rows of an id, or those without one, go to many files.
Each row holds the document's place in its file part and its ids as a list. Dictionary-encoded ids
take two bytes at most before compression; row groups and pages are small enough that the page
index lets a reader fetch the metadata columns, or the ids of a few documents, alone.

Null or empty texts are the end id alone. Repeated rows are separate documents. An empty table
gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import doc_id_of, forget_later, parallelism, shared_dir, ship, text_of, text_slices
from .bpe import Encoder, loaded, vocabulary_path

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 1 << 20

FILE = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, vocabulary: str | None = None) -> None:
    """Encode ``docs`` and write the token files under ``path``, on any file system of Spark's."""
    ship(docs.sparkSession)
    vocab = vocabulary or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        encoder, part, start = loaded(Encoder, vocab), TaskContext.get().partitionId(), 0
        for rows, texts in text_slices(batches):
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.ids(texts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            done = np.cumsum(sizes)
            offsets = np.concatenate([[0], done]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + done - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(done[-1])

    rows = docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parallelism(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    (
        ordered.mapInArrow(run, FILE)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens, start: reads the metadata columns only.

    The parts' totals are one row for each file, so they are summed up and joined as a small table.
    """
    rows = spark.read.schema(FILE).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return rows.join(F.broadcast(_bases(rows)), "part").select(
        "doc_id", "part", "local_start", "n_tokens", (F.col("base") + F.col("local_start")).alias("start")
    )


def _bases(rows: DataFrame) -> DataFrame:
    """Tokens before each file part; bounded by the number of parts."""
    spark = rows.sparkSession
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, out = 0, []
    for part, n in totals:
        out.append((part, base))
        base += n
    return spark.createDataFrame(out, "part int, base long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files."""
    rows = spark.read.schema(FILE).parquet(path)
    bases = _bases(rows.select("part", "n_tokens"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of ``read_tokens``."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_round_trip(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write the token files and return what reading them back shows; without ``path`` they go with the driver."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
        forget_later(spark, path)
    write_token_files(docs, path, end_id, vocabulary)
    return checksums(read_tokens(spark, path))
