"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

A document's set is its distinct five-word shingles (ASCII white space parts words, A-Z in lower
case; a text of fewer words is one shingle), each of weight 1; with ``weighted`` a shingle weighs as
often as the text has it. Texts of equal words are one vertex. Vertices that share a band key are
candidates; each pair is verified by the exact (weighted) Jaccard similarity of the sets, and the
classes are the connected components of the verified links.

No bucket is expanded into a table of all its pairs. Each bucket has a pivot, the member that shares
most buckets with others. First every text is compared with one pivot, that of most of its buckets,
then with the other pivots of its buckets that are not in its class by now; pivots with many members
are salted. The pivot then leaves the bucket. Buckets whose rest is of one class are done; the others,
which are few, are compared in blocks bounded by members and bytes: members outside a bucket's largest
class visit all its blocks, and a task computes the similarities of one block and its visitors at once
and returns no more links than it has members. So every two texts that share a bucket are compared
unless they are in one class already, and no link between classes is left out.

Null or empty texts (no word) are never near-duplicates: each such row is its own class with a null
class_id. Otherwise class_id is the smallest doc_id of the class (null if all its ids are null).
Repeated rows are copies, of which one is kept. An empty table gives no rows. ``drop_near_duplicates`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._common import doc_id_of, ease, parallelism, ship, stored, text_of, text_slices
from .dart_minhash import band_keys, cells, jaccard, shingles, signatures

SIMILARITY = 0.8
#: Members of a pivot compared by one task.
MEMBERS_PER_TASK = 256
#: Members and bytes of a block, about; a block and as many visitors meet in one task.
BLOCK_MEMBERS = 256
BLOCK_BYTES = 1 << 20
#: Pairs of a block's shared shingles that are counted at once.
COUNTED_PAIRS = 1 << 22
_NULL_ID = -(1 << 63)

_SKETCH = "doc_id long, id_key long, text_hash long, vertex binary, bytes long, bands array<long>"


def _identified(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(doc_id_of(docs).alias("doc_id"), F.coalesce(doc_id_of(docs), F.lit(_NULL_ID)).alias("id_key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _sketches(docs: DataFrame, weighted: bool) -> DataFrame:
    """id, vertex (hash of the words, null without words), size and band keys of every row."""

    def run(batches):
        for rows, texts in text_slices(batches):
            hashes, doc = shingles(texts)
            cell, owner = cells(hashes, doc, counted=weighted)
            keys = band_keys(signatures(cell, owner, len(texts)))
            some = np.bincount(doc, minlength=len(texts)) > 0
            vertex = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) if w else None for t, w in zip(texts, some.tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum(np.where(some, keys.shape[1], 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(vertex, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), bands], names=["doc_id", "id_key", "text_hash", "vertex", "bytes", "bands"])

    # each row has a number of its own, so that one of several equal rows can be kept
    return _identified(docs).mapInArrow(run, _SKETCH).withColumn("row_no", F.monotonically_increasing_id())


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """The pairs (pivot, member) whose shingle sets reach the similarity.

    ``texts`` has vertex and text. Members are sent to their pivot; a pivot with many members is
    sent to as many tasks, which read its set once and compare the members one by one.
    """
    spark = pairs.sparkSession
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    members = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "vertex")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("pivot").alias("vertex"))
    rows = members.unionByName(pivots).join(texts, "vertex")
    rows = rows.repartition(parallelism(spark), "pivot", "part").sortWithinPartitions("pivot", "part", "role", "vertex")

    def run(batches):
        pivot, own = None, None
        for batch, values in text_slices(batches):
            hashes, doc = shingles(values)
            hashes, doc = cells(hashes, doc, counted=weighted)
            bounds = np.searchsorted(doc, np.arange(len(values) + 1))
            out = ([], [])
            columns = (batch.column(c).to_pylist() for c in ("pivot", "part", "role", "vertex"))
            for i, (p, part, role, vertex) in enumerate(zip(*columns, strict=True)):
                mine = hashes[bounds[i] : bounds[i + 1]] if not weighted else np.sort(hashes[bounds[i] : bounds[i + 1]])
                if role == 0:
                    pivot, own = (p, part), mine.copy()
                elif pivot == (p, part) and jaccard(own, mine) >= similarity:
                    out[0].append(p)
                    out[1].append(vertex)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["pivot", "vertex"])

    return rows.select("pivot", "part", "role", "vertex", "text").mapInArrow(run, "pivot binary, vertex binary")


def _pivot_pairs(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (pivot, vertex, shared buckets), buckets (key, vertex, bytes) without their pivots).

    What is known of a key is stored before it is joined on, so that both sides of the join are plain
    exchanges and adaptive execution can split the members of a large bucket.
    """
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
    shared = stored(keyed.join(sizes, "key"), "near-buckets")
    degree = shared.groupBy("vertex").agg(F.sum("n").alias("degree"))
    ranked = shared.select("key", "vertex").join(degree, "vertex")
    first = stored(ranked.groupBy("key").agg(F.max(F.struct("degree", "vertex"))["vertex"].alias("pivot")), "near-pivots")
    rest = stored(shared.select("key", "vertex", "bytes").join(first, "key").where(F.col("vertex") != F.col("pivot")), "near-members")
    return rest.groupBy("pivot", "vertex").agg(F.count("*").alias("shared")), rest.select("key", "vertex", "bytes")


def _named(classes: DataFrame, of: str, name: str) -> DataFrame:
    return classes.select(F.col("vertex").alias(of), F.col("component").alias(name))


def _pivot_links(pairs: DataFrame, texts: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Links of texts and pivots: first with one pivot of each text, then with those of other classes."""
    best = pairs.groupBy("vertex").agg(F.max(F.struct("shared", "pivot"))["pivot"].alias("pivot"))
    links = stored(_verified(best.select("pivot", "vertex"), texts, similarity, weighted), "near-links")
    classes = stored(components(links, "pivot", "vertex", small=0), "near-components")
    own, other = _named(classes, "vertex", "a"), _named(classes, "pivot", "b")
    left = pairs.join(best.withColumnRenamed("pivot", "best"), "vertex").where(F.col("pivot") != F.col("best")).select("pivot", "vertex")
    left = left.join(own, "vertex", "left").join(other, "pivot", "left").where(F.coalesce("a", "vertex") != F.coalesce("b", "pivot"))
    left = stored(left.select("pivot", "vertex"), "near-pairs")
    ease(pairs.sparkSession)
    more = _verified(left, texts, similarity, weighted)
    # the classes so far stand for their links
    return stored(classes.where("vertex <> component").select(F.col("component").alias("pivot"), "vertex").unionByName(more), "near-links")


def _open_buckets(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """key, vertex, bytes, class, n of the buckets whose members are of more than one class, equal buckets once."""
    rows = stored(rest.join(_named(classes, "vertex", "component"), "vertex", "left").select("key", "vertex", "bytes", F.coalesce("component", "vertex").alias("class")), "near-classed")
    h = F.xxhash64("vertex")
    per_key = rows.groupBy("key").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s")
    )
    once = stored(per_key.where("lo <> hi").groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key"), "near-open-keys")
    return rows.join(once, "key")


def _block_links(buckets: DataFrame, texts: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Links (pivot, vertex) between the classes of each bucket.

    The largest class of a bucket is not compared with itself: its members only sit in their blocks,
    where the members of the other classes visit them and each other, a block of visitors at a time.
    """
    classes = buckets.groupBy("key", "class").agg(F.count("*").alias("held"), F.sum("bytes").alias("bytes"))
    main = classes.groupBy("key").agg(F.max(F.struct("held", "class", "bytes")).alias("main"), F.sum("held").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_BYTES)).cast("int")
    seats, guests = blocks(F.col("n"), F.col("bytes")), blocks(F.col("n") - F.col("main.held"), F.col("bytes") - F.col("main.bytes"))
    main = stored(main.select("key", F.col("main.class").alias("main"), seats.alias("seats"), guests.alias("guests")), "near-blocks")
    rows = buckets.select("key", "vertex", "class").join(main, "key")
    place = lambda n, seed: F.pmod(F.xxhash64("vertex", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = rows.select("key", "vertex", "class", F.lit(False).alias("visits"), place("seats", 1).alias("seat"), every("guests").alias("guest"))
    visitors = rows.where(F.col("class") != F.col("main")).select("key", "vertex", "class", F.lit(True).alias("visits"), every("seats").alias("seat"), place("guests", 2).alias("guest"))
    rows = residents.unionByName(visitors).join(texts, "vertex")

    def compare(frame):
        import pandas as pd

        visits, out = frame["visits"].to_numpy(bool), []
        if visits.any() and not visits.all():
            vertices, classes = frame["vertex"].tolist(), np.unique(frame["class"].to_numpy(), return_inverse=True)[1]
            hashes, doc = shingles(frame["text"].tolist())
            hashes, doc = cells(hashes, doc, counted=weighted)
            size = np.bincount(doc, minlength=len(frame))
            here, there = np.flatnonzero(visits), np.flatnonzero(~visits)
            shared = _shared_counts(hashes, doc, here, there)
            alike = shared >= similarity * (size[here][:, None] + size[there][None, :] - shared) - 1e-9
            alike &= classes[here][:, None] != classes[there][None, :]
            group = np.arange(classes.max() + 1)
            for i, j in zip(*np.nonzero(alike), strict=True):
                x, y = group[classes[here[i]]], group[classes[there[j]]]
                if x != y:
                    group[group == y] = x
                    out.append((vertices[here[i]], vertices[there[j]]))
        return pd.DataFrame(out, columns=["pivot", "vertex"])

    return rows.groupBy("key", "seat", "guest").applyInPandas(compare, "pivot binary, vertex binary")


def _shared_counts(hashes: np.ndarray, doc: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Number of elements that each set of ``rows`` shares with each of ``columns``, by the elements' holders."""
    n = int(doc.max(initial=0)) + 1
    row = np.full(max(n, int(rows.max()) + 1, int(columns.max()) + 1), -1)
    column = row.copy()
    row[rows], column[columns] = np.arange(len(rows)), np.arange(len(columns))
    left = row[doc] >= 0
    a, x = hashes[left], row[doc[left]]
    b, y = hashes[~left], column[doc[~left]]
    order = np.argsort(b, kind="stable")
    b, y = b[order], y[order]
    low, high = np.searchsorted(b, a, side="left"), np.searchsorted(b, a, side="right")
    held = high - low
    a, x, low, held = a[held > 0], x[held > 0], low[held > 0], held[held > 0]
    out = np.zeros(len(rows) * len(columns), np.int64)
    done = np.cumsum(held)
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + COUNTED_PAIRS, side="right")))
        n = held[at:to]
        ends = np.cumsum(n)
        other = y[np.repeat(low[at:to] - ends + n, n) + np.arange(int(ends[-1]))]
        out += np.bincount(np.repeat(x[at:to], n) * len(columns) + other, minlength=len(out))
        at = to
    return out.reshape(len(rows), len(columns))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """doc_id, id_key, text_hash, row_no, vertex, class (a vertex; null without words) of every row."""
    ship(docs.sparkSession)
    sketches = stored(_sketches(docs, weighted), "near-sketches")
    vertices = sketches.where("vertex IS NOT NULL").groupBy("vertex").agg(F.first("bands").alias("bands"), F.min(F.struct("id_key", "text_hash", "bytes")).alias("row"))
    pairs, rest = _pivot_pairs(vertices.select("vertex", F.col("row.bytes").alias("bytes"), F.explode("bands").alias("key")))
    pairs = stored(pairs, "near-pairs")
    ease(docs.sparkSession)
    wanted = pairs.select("vertex").unionByName(pairs.select(F.col("pivot").alias("vertex"))).distinct()
    wanted = wanted.join(vertices.select("vertex", "row.id_key", "row.text_hash"), "vertex")
    # copies of one row would give its vertex more than once
    texts = stored(_identified(docs).select("id_key", "text_hash", "text").join(wanted, ["id_key", "text_hash"]).dropDuplicates(["id_key", "text_hash"]).select("vertex", "text"), "near-texts")
    ease(docs.sparkSession)
    links = _pivot_links(pairs, texts, similarity, weighted)
    classes = components(links, "pivot", "vertex", small=0)
    buckets = stored(_open_buckets(rest, classes), "near-open")
    if not buckets.isEmpty():
        more = stored(_block_links(buckets, texts, similarity, weighted), "near-links")
        ease(docs.sparkSession)
        if not more.isEmpty():
            classes = components(links.unionByName(more), "pivot", "vertex", small=0)
    rows = sketches.select("doc_id", "id_key", "text_hash", "row_no", "vertex")
    return rows.join(_named(classes, "vertex", "component"), "vertex", "left").select("doc_id", "id_key", "text_hash", "row_no", "vertex", F.coalesce("component", "vertex").alias("class"))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """doc_id, class_id, class_size (rows) and is_kept of every row."""
    rows = stored(near_duplicate_classes(docs, similarity, weighted), "near-classes")
    kept = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id_key", "text_hash", "row_no")).alias("kept"), F.count("*").alias("size"), F.min("doc_id").alias("class_id"))
    # stored, so that adaptive execution can split the rows of a large class
    return rows.join(stored(kept, "near-kept"), "class", "left").select(
        "doc_id", "class_id",
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("kept.row_no") == F.col("row_no"), F.lit(True)).alias("is_kept"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id."""
    rows = near_duplicate_classes(docs, similarity, weighted)
    kept = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id_key", "text_hash")).alias("kept")).select("kept.id_key", "kept.text_hash")
    kept = kept.select(F.col("id_key").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    text = text_of(docs)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(doc_id_of(docs), F.lit(_NULL_ID)).alias("kept_id"), F.xxhash64(text).alias("kept_hash"))
    has_word = F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = whole.where(has_word).join(kept, ["kept_id", "kept_hash"]).dropDuplicates(["kept_id", "kept_hash"])
    return first.select("row").unionByName(whole.where(~has_word).select("row")).select("row.*")
