"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. One longer than a sequence is cut into full pieces and a
rest. Pieces are packed by bounded-space online best fit: a fixed number of open bins, found through
a bitset keyed by free space; a piece goes to the bin it fills most; where none takes it a new bin
opens, and if too many are open the fullest closes. Partitions pack independently; the bins that
they leave open are packed again as whole items, so a partition wastes next to nothing.

Null or empty texts are the end id alone. Repeated rows and repeated or null ids are packed row by
row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, ship, stored, text_of, text_slices
from .bpe import Encoder, loaded, vocabulary_path

OPEN_BINS = 512
#: Pieces that one task packs.
PIECES_PER_TASK = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, bin_used long, bin_open boolean"


class OnlineBestFit:
    """Bounded-space best fit; ``add`` returns (bin, offset in it), bins are numbered from 0."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free_bits = 0  # bit f is set if an open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open, self.n_bins = 0, 0
        self.used: list[int] = []

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def add(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.most and length < self.capacity:  # the fullest closes; a full bin needs no place
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, b = self.capacity, self.n_bins
            self.n_bins += 1
            self.used.append(0)
        offset = self.capacity - free
        self.used[b] = offset + length
        free -= length
        if free:
            self.by_free[free].append(b)
            self.free_bits |= 1 << free
            self.n_open += 1
        return b, offset

    def open_bins(self) -> set[int]:
        return {b for bins in self.by_free for b in bins}


def token_pieces(docs: DataFrame, capacity: int, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document: place and checksum of its ids."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        encoder = loaded(Encoder, path)
        for rows, texts in text_slices(batches):
            out = ([], [], [], [], [])
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    for column, value in zip(out, (doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, PIECES)


def _placing(capacity: int, open_bins: int):
    """A mapInArrow function that packs the rows of its partition by their ``length``."""

    def run(batches):
        from pyspark import TaskContext

        packer, base = OnlineBestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        kept, bins, offsets = [], [], []
        for batch in batches:
            placed = [packer.add(n) for n in batch.column("length").to_pylist()]
            kept.append(batch)
            bins.append(np.array([b for b, _ in placed], np.int64))
            offsets.append(np.array([o for _, o in placed], np.int64))
        used = np.array(packer.used, np.int64)
        still = np.zeros(len(used), bool)
        still[list(packer.open_bins())] = True
        for batch, b, o in zip(kept, bins, offsets, strict=True):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(b + base), pa.array(o), pa.array(used[b]), pa.array(still[b])],
                names=[*batch.schema.names, "bin", "offset", "bin_used", "bin_open"],
            )

    return run


def pack(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Columns of ``pieces`` with sequence_id and offset; ``pieces`` is a stored table."""
    n = pieces.count()
    tasks = n // pieces_per_task + 1
    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), *map(F.col, ("doc_id", "piece", "ids_crc32", "start", "length"))]
    first = (
        pieces.repartition(tasks, order[0])
        .sortWithinPartitions(*order)
        .mapInArrow(_placing(capacity, open_bins), PLACED)
    )
    first = stored(first, "packing-first")
    rest = first.where("bin_open").groupBy("bin").agg(F.first("bin_used").alias("length")).select("bin", "length")
    # whole bins left open, largest first: they are few, a fixed number for each task before
    again = rest.repartition(tasks * open_bins // pieces_per_task + 1, F.xxhash64("bin")).sortWithinPartitions(F.desc("length"), "bin")
    again = again.withColumnRenamed("bin", "left_bin").mapInArrow(
        _placing(capacity, open_bins), "left_bin long, length long, bin long, offset long, bin_used long, bin_open boolean"
    )
    again = again.select("left_bin", F.col("bin").alias("new_bin"), F.col("offset").alias("shift"))
    joined = first.join(again, F.col("bin") == F.col("left_bin"), "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce(F.col("new_bin") * 2 + 1, F.col("bin") * 2).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def best_fit_packing(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    return pack(stored(token_pieces(docs, capacity, end_id, vocabulary), "packing-pieces"), capacity, open_bins)
