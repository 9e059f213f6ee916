"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case, kept as a
128-bit hash. The reference table counts, for every key, the documents (rows) that have it; it takes
insertions and deletions of documents as signed counts. The filters hold the keys whose count has
reached the threshold, in as many shards of bounded size as their number needs: a probe passes lines
that may be frequent, the exact table then decides. Filters that get too full after insertions are
built anew from the table with more shards; at ``MOST_SHARDS`` a full shard lets everything pass, so
the result never depends on the filters.

The keys of the largest counts, ``HEAD_KEYS`` at most, are known to the probe itself. Their lines are
decided there and dealt at random through the join, so no common line is a hot key of it.

Each row is a document; a repeated row counts again and gets its own row back. Null and empty texts
have one empty line, whose empty key is never dropped. An empty table gives no rows. ``line_dedup``
reads doc_id and text only; ``drop_repeated_lines`` keeps all other columns whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, parallelism, ship, stored, text_of, text_slices
from .cuckoo import CuckooFilter
from .words import mix

THRESHOLD = 10
#: Most buckets of a shard's filter, 8 bytes each, and most shards: 64 MB of filters.
SHARD_BUCKETS = 1 << 16
MOST_SHARDS = 128
#: Keys that a shard is planned for.
SHARD_KEYS = 200_000
#: A key with at least this share of all counted lines is in the head, so it has no more than 1 / share keys.
HEAD_KEYS = 10_000

_SPACE = b" \t\n\x0b\x0c\r"
_NO_KEY = bytes(16)
REFS = "hi long, lo long, n_docs long"


def _keys(text: str) -> list[bytes]:
    """Key hash of each line; zeros for an empty key."""
    out = []
    for line in text.encode().split(b"\n"):
        key = line.strip(_SPACE)
        out.append(xxhash.xxh3_128_digest(key.lower()) if key else _NO_KEY)
    return out


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)


def _line_refs(batches):
    """(hi, lo) of every key once for each document."""
    for _, texts in text_slices(batches):
        found = []
        for t in texts:
            keys = set(_keys(t))
            keys.discard(_NO_KEY)
            found.extend(keys)
        both = _halves(found)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hi", "lo"])


def _filters_of(batches):
    """Cuckoo filters of the shards in this partition, which come sorted by shard."""
    shard, held = None, []

    def built():
        f = CuckooFilter.of(np.concatenate(held), SHARD_BUCKETS) if len(held) else CuckooFilter()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.to_bytes()], pa.binary())], names=["shard", "filter"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        keys = batch.column("lo").to_numpy().astype(np.uint64)
        for s in np.unique(shards).tolist():
            if s != shard:
                if shard is not None:
                    yield built()
                shard, held = s, []
            if sum(map(len, held)) <= SHARD_BUCKETS * 4:  # beyond it the filter lets all pass anyway
                held.append(keys[shards == s])
    if shard is not None:
        yield built()


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


class _Head:
    """Exact membership of the few most common keys."""

    def __init__(self, keys: np.ndarray):
        keys = keys[np.lexsort((keys[:, 0], keys[:, 1]))]
        one = np.ones(len(keys), bool)  # keys that share a half are left to the table
        one[1:] &= keys[1:, 1] != keys[:-1, 1]
        one[:-1] &= keys[1:, 1] != keys[:-1, 1]
        self.hi, self.lo = keys[one, 0], keys[one, 1]

    def holds(self, both: np.ndarray) -> np.ndarray:
        if not len(self.lo):
            return np.zeros(len(both), bool)
        at = np.minimum(np.searchsorted(self.lo, both[:, 1]), len(self.lo) - 1)
        return (self.lo[at] == both[:, 1]) & (self.hi[at] == both[:, 0])


@dataclass
class LineIndex:
    """Reference counts of all line keys and the filters of the frequent ones."""

    refs: DataFrame
    threshold: int
    shards: int
    filters: dict[int, bytes]

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = THRESHOLD) -> LineIndex:
        return cls.of(stored(_refs(docs), "line-refs"), threshold)

    @classmethod
    def of(cls, refs: DataFrame, threshold: int) -> LineIndex:
        """The index of a stored reference table; filters are sized by the number of frequent keys."""
        frequent = refs.where(F.col("n_docs") >= threshold)
        shards = min(MOST_SHARDS, frequent.count() // SHARD_KEYS + 1)
        return cls(refs, threshold, shards, _build_filters(frequent, shards))

    def head(self) -> _Head:
        """The keys of at least 1 / HEAD_KEYS of all counted lines."""
        total = self.refs.agg(F.sum("n_docs")).first()[0] or 0
        rows = self.refs.where(F.col("n_docs") >= max(self.threshold, -(-total // HEAD_KEYS))).select("hi", "lo").collect()
        return _Head(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out again; they must have been inserted."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = _refs(docs).withColumn("n_docs", F.col("n_docs") * sign)
        both = self.refs.withColumn("was", F.col("n_docs")).unionByName(change.withColumn("was", F.lit(0).cast("long")))
        both = stored(both.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.sum("was").alias("was")), "line-refs")
        refs = both.where("n_docs > 0").select("hi", "lo", "n_docs")
        t = self.threshold
        crossed = both.where((F.col("n_docs") >= t) != (F.col("was") >= t)).select("hi", "lo", (F.col("n_docs") >= t).alias("enters"), _shard(self.shards).alias("shard"))
        filters = self.filters | _update_filters(crossed, self.filters)
        if self.shards < MOST_SHARDS and any(raw[0] for raw in filters.values()):  # a filter is full
            return LineIndex.of(stored(refs, "line-refs"), t)
        return LineIndex(refs, t, self.shards, filters)

    def frequent_lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_hash, lines: positions of the frequent lines of each distinct document."""
        spark = docs.sparkSession
        shared, shards, head = spark.sparkContext.broadcast(self.filters), self.shards, self.head()

        def probe(batches):
            filters = {s: CuckooFilter.from_bytes(raw) for s, raw in shared.value.items()}
            for rows, texts in text_slices(batches):
                keys = [_keys(t) for t in texts]
                sizes = [len(k) for k in keys]
                both = _halves([k for ks in keys for k in ks])
                row = np.repeat(np.arange(len(texts)), sizes)
                place = np.concatenate([np.arange(n) for n in sizes])
                hit = np.zeros(len(both), bool)
                shard = both[:, 0] % shards
                for s, f in filters.items():
                    mine = np.flatnonzero(shard == s)
                    hit[mine] = f.contains(both[mine, 1])
                hit &= (both != 0).any(1)
                row, place, both = row[hit], place[hit], both[hit]
                sure = head.holds(both)
                # a sure line needs no key: it gets one of its own that no line has
                both[sure, 0] = mix(rows.column(1).to_numpy()[row[sure]].astype(np.uint64) + place[sure].astype(np.uint64)).astype(np.int64)
                both[sure, 1] = 0
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(take), rows.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sure)],
                    names=["doc_id", "text_hash", "line", "hi", "lo", "sure"],
                )

        maybe = _identified(docs).mapInArrow(probe, "doc_id long, text_hash long, line int, hi long, lo long, sure boolean")
        exact = self.refs.where(F.col("n_docs") >= self.threshold).select("hi", "lo", F.lit(True).alias("frequent"))
        found = maybe.join(exact, ["hi", "lo"], "left").where("sure OR frequent")
        return found.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


def _refs(docs: DataFrame) -> DataFrame:
    keys = docs.select(text_of(docs).alias("text")).mapInArrow(_line_refs, "hi long, lo long")
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))


def _build_filters(frequent: DataFrame, shards: int) -> dict[int, bytes]:
    rows = frequent.select(_shard(shards).alias("shard"), "lo").repartition(min(shards, parallelism(frequent.sparkSession)), "shard").sortWithinPartitions("shard")
    return {r["shard"]: bytes(r["filter"]) for r in rows.mapInArrow(_filters_of, "shard int, filter binary").collect()}


def _update_filters(crossed: DataFrame, filters: dict[int, bytes]) -> dict[int, bytes]:
    """Insert the keys that reached the threshold and delete those that fell below it."""
    shared = crossed.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        open_filters: dict[int, CuckooFilter] = {}
        full: set[int] = set()
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("shard", "lo", "enters")), strict=True)
            for s, lo, enters in columns:
                if s not in open_filters:
                    raw = shared.value.get(s)
                    open_filters[s] = CuckooFilter.from_bytes(raw) if raw else CuckooFilter(SHARD_BUCKETS >> 4)
                f = open_filters[s]
                if not (f.insert(lo) if enters else f.delete(lo)):
                    full.add(s)
        for s, f in open_filters.items():
            f.saturated |= s in full
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([f.to_bytes()], pa.binary())], names=["shard", "filter"])

    rows = crossed.repartition(parallelism(crossed.sparkSession), "shard")
    return {r["shard"]: bytes(r["filter"]) for r in rows.mapInArrow(run, "shard int, filter binary").collect()}


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(doc_id_of(docs).alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"), text_of(docs).alias("text"))


def _with_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` (struct row, doc_id, text) with the positions of the lines to drop."""
    lines = lines.select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), "lines")
    same = docs["text_hash"].eqNullSafe(lines["l_hash"]) & docs["doc_id"].eqNullSafe(lines["l_id"])
    return docs.join(lines, same, "left").drop("l_id", "l_hash")


def _kept(text: str, drop: list[int] | None) -> tuple[str, int]:
    """(text without the lines at these places, lines before)."""
    if not drop:
        return text, text.count("\n") + 1
    lines, gone = text.split("\n"), set(drop)
    return "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines)


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    ship(docs.sparkSession)
    index = index or LineIndex.build(docs, threshold)

    def run(batches):
        for rows, texts in text_slices(batches):
            n, dropped, sha = [], [], []
            for text, drop in zip(texts, rows.column("lines").to_pylist(), strict=True):
                kept, lines = _kept(text, drop)
                n.append(lines)
                dropped.append(len(drop or ()))
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = _with_lines(_identified(docs), index.frequent_lines(docs)).select("doc_id", "text", "lines")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text`` and ``n_chars`` set to its new length."""
    ship(docs.sparkSession)
    index = index or LineIndex.build(docs, threshold)
    whole = docs.select(F.struct("*").alias("row"), doc_id_of(docs).alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"))
    rows = _with_lines(whole, index.frequent_lines(docs))
    # lines are counted from 0 by transform's index; documents without frequent lines stay as they are
    # the lines are bound once, as the only element of an array; the places that stay are a set difference
    left = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "lines")
    joined = F.transform(F.array(F.split(F.col("row.text"), "\n")), lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n"))
    kept = F.get(joined, F.lit(0))
    new = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(kept)
    size = F.when(F.col("lines").isNull(), F.col("row.n_chars")).otherwise(F.char_length(new)) if "n_chars" in docs.columns else F.lit(None)
    # in two steps: a column of ``docs`` may have the name of one used here
    rows = rows.select("row", new.alias("new_text"), size.alias("new_size"))
    out = {"text": F.col("new_text"), "n_chars": F.col("new_size").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(out[c] if c in out else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
