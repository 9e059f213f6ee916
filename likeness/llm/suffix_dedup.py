"""Exact substring dedup: every byte of a 400-byte string that starts anywhere else goes.

A global suffix array is not needed: a string of ``threshold`` bytes names its own anchor, the
smallest hashed 32-byte gram inside it (the leftmost of equals). Equal strings have equal anchors at
the same place, so they can only meet in one anchor's group. Neighbouring starts with one anchor form
a run, kept as a hash of the bytes that its strings cover:

* an anchor gram that occurs once in the corpus has no repeated string;
* a run whose bytes occur twice is repeated as a whole, however many copies there are;
* groups with different runs are searched by threshold-bounded interval expansion on a
  Burrows-Wheeler transform of the runs' bytes (``bwt_intervals``), a few whole groups at a time. A
  string reaches from the anchor over at least half of the rest to one side, so a run that has neither
  half-length side in common with another run of its group cannot share a string and is left out, and
  of one that has one side in common the other side is cut to less than that;
* groups with more distinct runs than one task should hold are counted by blocks of starts, down to
  single strings (place and two 64-bit hashes), which spreads over tasks and is as exact.

Strings are judged on the input texts; matches never cross documents. Null or empty texts have no
bytes. Repeated rows are copies of each other, so their repeated strings go in each. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, parallelism, ship, stored, text_of, text_slices
from .bwt_intervals import repeated_starts
from .words import BY_BYTE, mix

THRESHOLD = 400
GRAM = 32
#: Distinct runs of one anchor that are searched together; larger groups are split by content.
MOST_RUNS = 1_500
#: Bytes of whole groups that one interval expansion takes.
CHUNK_BYTES = 1 << 20
#: Starts in a block of a group that is split, level by level; each is less than half the threshold.
WIDTHS = (64, 8, 1)
#: Starts of one text handled at once.
PIECE = 1 << 20
_NULL_ID = -(1 << 63)
_BASE, _OTHER = 0xD1342543DE82EF95, 0x2545F4914F6CDD1D

RUNS = "id_key long, text_hash long, anchor long, content long, size int, back int, starts array<int>"
KEY = ["anchor", "content", "size", "back"]

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool) -> np.ndarray:
    """Powers of an odd base, or of its inverse, modulo 2^64."""
    table = _powers.get((base, inverse))
    if table is None or len(table) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        factors = np.full(max(n, PIECE + 2 * THRESHOLD), b, np.uint64)
        factors[0] = 1
        table = _powers[base, inverse] = np.cumprod(factors)
    return table[:n]


class RollingHash:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.base, self.total = base, np.zeros(n + 1, np.uint64)
        np.cumsum(BY_BYTE[data] * _power(base, n, False), out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * _power(self.base, len(self.total), True)[starts])


def _sliding_first_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least key of each window of ``width`` keys (keys hold their place, so the first of equals)."""
    n = len(key) - width + 1
    pad = -len(key) % width
    grid = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD):
    """Runs of starts with one anchor in the texts data[begins[i]:ends[i]].

    Returns (text, first start, last start, anchor place, anchor hash, content hash) arrays.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < threshold:
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    if n >> 24:
        raise ValueError("places are kept in 24 bits: cut the bytes into pieces first")
    h = RollingHash(data)
    place = np.arange(n - GRAM + 1)
    gram = h(place, place + GRAM)
    key = (gram & ~np.uint64(0xFFFFFF)) | place.astype(np.uint64)
    best = _sliding_first_least(key, threshold - GRAM + 1) & np.uint64(0xFFFFFF)
    best = best.astype(np.int64)
    # only starts whose string lies in one text
    room = np.zeros(n - threshold + 2, np.int8)
    long = np.flatnonzero(ends - begins >= threshold)
    room[begins[long]] += 1
    room[ends[long] - threshold + 1] -= 1
    valid = np.cumsum(room[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (best[1:] != best[:-1])
    new[begins[long]] = True
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    text = np.searchsorted(begins, first, side="right") - 1
    anchor = best[first]
    content = RollingHash(data, _OTHER)(first, last + threshold)
    return text, first, last, anchor, gram[anchor], content


def _run_rows(threshold: int):
    """mapInArrow function: the distinct runs of each text and where they start."""

    def emit(ids, hashes, data, begins, ends, shift):
        text, first, last, anchor, gram, content = runs_of(data, begins, ends, threshold)
        back = anchor - first
        size = last - first + threshold
        mixed = mix(mix(gram + text.astype(np.uint64) * np.uint64(_BASE)) + content + size.astype(np.uint64) * np.uint64(_OTHER) + back.astype(np.uint64))
        order = np.argsort(mixed, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = mixed[order][1:] != mixed[order][:-1]
        pick = order[new]
        offsets = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
        starts = (first - begins[text] + shift)[order].astype(np.int32)
        take = pa.array(text[pick])
        return pa.RecordBatch.from_arrays(
            [
                ids.take(take), hashes.take(take),
                pa.array(gram[pick].astype(np.int64)), pa.array(content[pick].astype(np.int64)),
                pa.array(size[pick].astype(np.int32)), pa.array(back[pick].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts)),
            ],
            names=["id_key", "text_hash", "anchor", "content", "size", "back", "starts"],
        )

    def run(batches):
        for rows, texts in text_slices(batches):
            parts = [t.encode() for t in texts]
            if len(parts) == 1 and len(parts[0]) > PIECE + threshold:
                for shift in range(0, len(parts[0]) - threshold + 1, PIECE):
                    data = np.frombuffer(parts[0], np.uint8)[shift : shift + PIECE + threshold - 1]
                    yield emit(rows.column(0), rows.column(1), data, np.array([0]), np.array([len(data)]), shift)
                continue
            data = np.frombuffer(b"".join(parts), np.uint8)
            sizes = np.array([len(p) for p in parts])
            yield emit(rows.column(0), rows.column(1), data, np.cumsum(sizes) - sizes, np.cumsum(sizes), 0)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(doc_id_of(docs).alias("doc_id"), F.coalesce(doc_id_of(docs), F.lit(_NULL_ID)).alias("id_key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """KEY, kinds, bytes of the wanted runs (KEY, kinds, id_key, text_hash, start)."""
    each = wanted.groupBy("id_key", "text_hash").agg(F.collect_list(F.struct(*KEY, "kinds", "start")).alias("runs"))
    rows = _texts(docs).select("id_key", "text_hash", "text").join(each, ["id_key", "text_hash"]).select("text", "runs")

    def run(batches):
        for batch, texts in text_slices(batches):
            out = [[] for _ in range(6)]
            for text, runs in zip(texts, batch.column("runs").to_pylist(), strict=True):
                raw = text.encode()
                for r in runs:
                    for column, value in zip(out, (*(r[c] for c in (*KEY, "kinds")), raw[r["start"] : r["start"] + r["size"]]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())],
                names=[*KEY, "kinds", "bytes"],
            )

    # copies of one row give a run more than once
    return rows.mapInArrow(run, "anchor long, content long, size int, back int, kinds long, bytes binary").dropDuplicates(KEY)


FOUND = "anchor long, content long, size int, back int, ranges array<int>"


def _range_batch(keys: list[tuple], ranges: list[list[int]]) -> pa.RecordBatch:
    columns = list(zip(*keys, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(ranges, pa.list_(pa.int32()))], names=[*KEY, "ranges"])


def _ranges(mask: np.ndarray) -> list[int]:
    """First and last place of each stretch that is set, one after the other."""
    change = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1], 1).reshape(-1).tolist()


def _expanded(threshold: int):
    """mapInArrow function over runs sorted by anchor: places repeated among a group's distinct runs."""

    half = (threshold - GRAM + 1) // 2

    def common(keys, strings):
        """(key, first byte, bytes) of the parts of runs that may share a string with another run of the group."""
        sides = [((k[0], 0, s[k[3] - half : k[3]] if k[3] >= half else None), (k[0], 1, s[k[3] + GRAM : k[3] + GRAM + half] if len(s) >= k[3] + GRAM + half else None)) for k, s in zip(keys, strings, strict=True)]
        held = Counter(side for both in sides for side in both if side[2] is not None)
        for key, s, (left, right) in zip(keys, strings, sides, strict=True):
            has_left, has_right = held[left] > 1, held[right] > 1
            low = 0 if has_left else max(0, key[3] - half + 1)
            high = len(s) if has_right else min(len(s), key[3] + GRAM + half - 1)
            if (has_left or has_right) and high - low >= threshold:
                yield key, low, s[low:high]

    def search(keys, strings):
        parts = list(common(keys, strings))
        mask = repeated_starts([s for *_, s in parts], threshold) if parts else None
        at, found, ranges = 0, [], []
        for key, low, s in parts:
            r = _ranges(mask[at : at + len(s) - threshold + 1])
            at += len(s) + 1
            if r:
                found.append(key)
                ranges.append([low + x for x in r])
        return _range_batch(found, ranges)

    def run(batches):
        keys, strings, size = [], [], 0
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in (*KEY, "bytes")), strict=True):
                if size >= CHUNK_BYTES and keys[-1][0] != key[0]:  # only whole groups are searched
                    yield search(keys, strings)
                    keys, strings, size = [], [], 0
                keys.append(key[:4])
                strings.append(key[4])
                size += len(key[4])
        if keys:
            yield search(keys, strings)

    return run


PART = "anchor long, content long, size int, back int, at int, bytes binary"
PIECE_ROWS = "anchor long, content long, size int, back int, at int, bytes binary, block int, core long, h1 long, h2 long"


def _split(threshold: int, width: int):
    """mapInArrow function: the blocks of ``width`` starts, aligned to the anchor, of parts of runs.

    A block has the hash of its core, the bytes that all strings of the whole block share, and two
    hashes of all its bytes. Equal strings lie in blocks of equal number and core.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(10)]
            for *key, at, raw in zip(*(batch.column(c).to_pylist() for c in (*KEY, "at", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                n = len(data) - threshold + 1
                shift = at - key[3]  # place of the first start relative to the anchor
                blocks = np.arange(shift // width, (shift + n - 1) // width + 1)
                lo, hi = np.maximum(blocks * width - shift, 0), np.minimum((blocks + 1) * width - shift, n) - 1
                a, b = RollingHash(data), RollingHash(data, _OTHER)
                first, last = blocks * width - shift, (blocks + 1) * width - 1 - shift  # of the whole block, in the part or not
                core = a(last, first + threshold)
                whole = (a(lo, hi + threshold), b(lo, hi + threshold))
                for k in range(len(blocks)):
                    row = (*key, at + int(lo[k]), raw[lo[k] : hi[k] + threshold], int(blocks[k]), core[k], whole[0][k], whole[1][k])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(out, kinds, strict=False)), *(pa.array(np.array(c, np.uint64).astype(np.int64)) for c in out[7:])],
                names=[*KEY, "at", "bytes", "block", "core", "h1", "h2"],
            )

    return run


def _large_groups(runs: DataFrame, threshold: int) -> DataFrame:
    """KEY, ranges of the runs of large groups.

    Blocks of ever fewer starts are counted by their bytes: equal blocks are repeated as wholes, blocks
    whose core is met in one form only are not repeated, the others are halved further, down to
    single strings. Only a block at the border of a common passage goes on, so rows stay few.
    """
    parts, out = runs.withColumn("at", F.lit(0)), None
    for width in WIDTHS:
        pieces = stored(parts.select(*KEY, "at", "bytes").mapInArrow(_split(threshold, width), PIECE_ROWS), "substring-blocks")
        forms = stored(pieces.groupBy("anchor", "block", "core", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY[1:], "at")).alias("row")), "substring-forms")
        # stored, so that adaptive execution can split the blocks of a hot anchor
        same = stored(forms.where("n > 1").select("anchor", "block", "h1", "h2"), "substring-same")
        hit = pieces.join(same, ["anchor", "block", "h1", "h2"])
        hit = hit.select(*KEY, F.array(F.col("at"), F.col("at") + F.length("bytes") - threshold).alias("ranges"))
        out = hit if out is None else out.unionByName(hit)
        if width == 1:
            break
        several = forms.groupBy("anchor", "block", "core").agg(F.count("*").alias("forms")).where("forms > 1").select("anchor", "block", "core")
        several = stored(several, "substring-several")
        # one part of each form goes on; parts of a form with copies have their answer already
        left = forms.join(several, ["anchor", "block", "core"]).select("anchor", "row.*")
        parts = pieces.select(*KEY, "at", "bytes").join(left, [*KEY, "at"])
    return out


def repeated_ranges(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(runs of all texts, FOUND: ranges of repeated starts of each distinct run)."""
    spark = docs.sparkSession
    runs = stored(_texts(docs).select("id_key", "text_hash", "text").mapInArrow(_run_rows(threshold), RUNS), "substring-runs")
    # counts by anchor are stored, so that both sides of each join come from an exchange of their own
    # and adaptive execution can split the runs of a hot anchor over tasks
    twice = stored(runs.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("anchor"), "substring-anchors")
    runs = stored(runs.join(twice, "anchor"), "substring-candidates")
    distinct = runs.groupBy(*KEY).agg(F.sum(F.size("starts")).alias("n"), F.min(F.struct("id_key", "text_hash", F.col("starts")[0].alias("start"))).alias("row"))
    distinct = stored(distinct, "substring-distinct")
    whole = distinct.where("n > 1").select(*KEY, F.array(F.lit(0), F.col("size") - threshold).alias("ranges"))
    groups = stored(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "substring-groups")
    different = distinct.join(groups, "anchor")
    bytes_of = stored(_fetch(docs, different.select(*KEY, "kinds", "row.id_key", "row.text_hash", "row.start")), "substring-bytes")
    small = bytes_of.where(F.col("kinds") <= MOST_RUNS).select(*KEY, "bytes").repartition(parallelism(spark), "anchor").sortWithinPartitions(*KEY)
    found = small.mapInArrow(_expanded(threshold), FOUND)
    large = _large_groups(bytes_of.where(F.col("kinds") > MOST_RUNS).select(*KEY, "bytes"), threshold)
    # a run that is repeated as a whole may come from the search as well: the ranges are merged later
    return runs, whole.unionByName(found).unionByName(large)


def _cover(n: int, places: list, threshold: int) -> np.ndarray:
    """Which of n bytes the repeated strings cover; places: (starts, ranges) of runs."""
    edge = np.zeros(n + 1, np.int32)
    for p in places or ():
        starts, ranges = np.array(p["starts"], np.int64), np.array(p["ranges"], np.int64).reshape(-1, 2)
        np.add.at(edge, (starts[:, None] + ranges[:, 0]).reshape(-1), 1)
        np.add.at(edge, (starts[:, None] + ranges[:, 1]).reshape(-1) + threshold, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(n: int, places: list | None, threshold: int) -> np.ndarray:
    """Begin and end of each maximal stretch of n bytes that goes."""
    change = np.diff(np.concatenate([[0], _cover(n, places, threshold).astype(np.int8), [0]])) if places else np.zeros(0)
    return np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], 1)


def _without(raw: bytes, spans: np.ndarray) -> bytes:
    ends = [0, *spans[:, 1].tolist()]
    return b"".join(raw[a:b] for a, b in zip(ends, [*spans[:, 0].tolist(), len(raw)], strict=True))


def _places(docs: DataFrame, threshold: int) -> DataFrame:
    """id_key, text_hash, places (starts and ranges of repeated runs) of the rows that have any."""
    runs, found = repeated_ranges(docs, threshold)
    return runs.join(found, KEY).groupBy("id_key", "text_hash").agg(F.collect_list(F.struct("starts", "ranges")).alias("places"))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, spans (begin and end byte of each removed stretch, in order), kept_sha256 of every row."""
    ship(docs.sparkSession)
    rows = _texts(docs).join(_places(docs, threshold), ["id_key", "text_hash"], "left").select("doc_id", "text", "places")

    def run(batches):
        for batch, texts in text_slices(batches):
            sizes, spans, sha = [], [], []
            for text, places in zip(texts, batch.column("places").to_pylist(), strict=True):
                raw = text.encode()
                gone = _spans(len(raw), places, threshold)
                sizes.append(len(raw))
                spans.append([{"begin": a, "end": b} for a, b in gone.tolist()])
                sha.append(hashlib.sha256(_without(raw, gone)).hexdigest())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept_sha256 string")


def substring_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return repeated_spans(docs, threshold).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


def drop_repeated_substrings(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the bytes that go in ``text``; a character that a span cuts goes as a whole."""
    ship(docs.sparkSession)
    text = text_of(docs)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(doc_id_of(docs), F.lit(_NULL_ID)).alias("id_key"), F.xxhash64(text).alias("text_hash"))
    name = "_" * max(len(c) for c in docs.columns) + "places"  # no column of ``docs`` has it
    rows = whole.join(_places(docs, threshold), ["id_key", "text_hash"], "left").select("row.*", F.col("places").alias(name))
    k = docs.columns.index("text")

    def run(batches):
        for batch, texts in text_slices(batches, column=k):
            kept = batch.column(k).to_pylist()
            for i, places in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if places:
                    raw = texts[i].encode()
                    kept[i] = _without(raw, _spans(len(raw), places, threshold)).decode(errors="ignore")
            columns = [pa.array(kept, pa.string()) if c == k else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
