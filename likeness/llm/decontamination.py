"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Words are runs of ASCII letters, digits and characters above ASCII, in lower case. Passages are
windows of twice the longest item (``PASSAGE_WORDS`` at least), half overlapping, so every item-long
stretch lies whole in one. An item's impacts are its BM25 term weights over its own total, so a
passage that holds all its words scores 1, and one threshold fits all items.

Retrieval is block-max WAND and exact: postings are cut into blocks of items with the largest impact
of each term. The most common terms, which even together cannot lift any item to the threshold, have
no postings; what they can add is each block's rest. First, for whole batches of passages at once, the
blocks stay live whose rest and block maxima reach the threshold. In each live block cursors then
move over the items: the pivot is the first item at which the maxima of the cursors up to it reach the
threshold, all items before it are skipped, and only pivots that all cursors before have reached are
scored in full. An item is reported if it reaches the threshold and at least ``overlap`` of the
three-word shingles of both its question (the first two thirds of its words) and its answer (the rest)
are in the passage.

Items are taken in shards of ``ITEMS_PER_SHARD`` items and ``SHARD_CHARS`` characters at most, so a
broadcast index is bounded however many and long the items are; every shard costs a pass over the
documents. Item count, mean length, longest item and document frequencies are those of all items,
counted in DataFrame passes first, so the results do not depend on the shards. Null or empty texts and
items match nothing; repeated rows are reported each; an empty table gives no rows.
``drop_contaminated`` keeps all columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, drop_stored, ship, stored, text_of, text_slices
from .words import IntTable, span_hashes, texts_of

THRESHOLD = 0.6
OVERLAP = 0.5
PASSAGE_WORDS = 128
ITEMS_PER_SHARD = 20_000
SHARD_CHARS = 16 << 20
BLOCK_ITEMS = 8
#: Share of the threshold that the skipped, most common terms may reach together in any item.
SKIPPED = 0.75
K1, B = 1.2, 0.75

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text)."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD[data]
    change = np.diff(word)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return span_hashes(data, starts, ends), texts_of(starts, begins)


def _shingles(keys: np.ndarray) -> set:
    n = min(3, len(keys))
    return {tuple(keys[i : i + n].tolist()) for i in range(len(keys) - n + 1)} if n else set()


def _counted(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of each distinct word of each text, in order."""
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], words[at], np.diff(np.append(at, len(words)))


@dataclass
class Statistics:
    """Of all items that have words; ``terms`` (ascending) are those of one shard at least."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    frequency: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, doc: np.ndarray) -> Statistics:
        """For items that are all at hand."""
        lengths = np.bincount(doc)
        lengths = lengths[lengths > 0]
        terms, frequency = np.unique(_counted(words, doc)[1], return_counts=True)
        return cls(len(lengths), float(lengths.mean()) if len(lengths) else 0.0, int(lengths.max(initial=0)), terms, frequency)


@dataclass
class Index:
    """Normalised BM25 impacts of a shard of items, all in flat arrays."""

    ids: list[int]
    words: np.ndarray  # word hashes of the items one after the other
    word_begin: np.ndarray
    item_term: np.ndarray  # distinct word hashes of each item, ascending
    item_impact: np.ndarray
    item_begin: np.ndarray
    terms: np.ndarray  # hashes of the terms that have postings
    first: np.ndarray  # where each term's block postings begin
    block: np.ndarray
    most: np.ndarray  # largest impact of the term in the block
    post_begin: np.ndarray  # where each block posting's items begin
    post_item: np.ndarray
    rest: np.ndarray  # what the terms without postings can add, for each block
    passage: int

    @classmethod
    def of(cls, ids: list[int], texts: list[str], threshold: float, statistics: Statistics | None = None) -> Index:
        words, doc = word_keys(texts)
        some, doc = np.unique(doc, return_inverse=True)
        ids, n = [ids[i] for i in some.tolist()], len(some)
        statistics = statistics or Statistics.of(words, doc)
        length = np.bincount(doc, minlength=n)
        item, term, times = _counted(words, doc)
        frequency = statistics.frequency[np.searchsorted(statistics.terms, term)]
        norm = K1 * (1 - B + B * length[item] / statistics.mean) if n else np.zeros(0)
        raw = np.log(1 + (statistics.items - frequency + 0.5) / (frequency + 0.5)) * times * (K1 + 1) / (times + norm)
        impact = raw / np.bincount(item, raw, n)[item]
        # leave out the most common terms while no item can get near the threshold by them alone
        by_term = np.lexsort((item, term))
        t, i, v = term[by_term], item[by_term], impact[by_term]
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if n else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(t))
        keep, reach = np.ones(len(t), bool), np.zeros(n)
        held = frequency[by_term][begin] if n else np.zeros(0)
        for k in np.lexsort((t[begin], -held)).tolist() if n else ():
            if held[k] < 2:
                break
            a, b = begin[k], end[k]
            if (reach[i[a:b]] + v[a:b] <= SKIPPED * threshold).all():
                reach[i[a:b]] += v[a:b]
                keep[a:b] = False
        t, i, v = t[keep], i[keep], v[keep]
        rest = np.zeros(-(-n // BLOCK_ITEMS))
        np.maximum.at(rest, np.arange(n) // BLOCK_ITEMS, reach)
        terms, place = np.unique(t, return_inverse=True)
        block = i // BLOCK_ITEMS
        post = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (block[1:] != block[:-1]))) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(v, post) if len(post) else np.zeros(0)
        first = np.searchsorted(place[post], np.arange(len(terms) + 1))
        ends = np.concatenate([[0], np.cumsum(length)])
        return cls(
            ids, words, ends, term, impact, np.searchsorted(item, np.arange(n + 1)), terms, first, block[post], most,
            np.append(post, len(t)), i, rest, max(PASSAGE_WORDS, 2 * statistics.longest),
        )

    def impacts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of an item and their impacts."""
        a, b = self.item_begin[k], self.item_begin[k + 1]
        return self.item_term[a:b], self.item_impact[a:b]


def pivots(cursors: list[tuple[list[int], float]], rest: float, threshold: float) -> Iterator[int]:
    """The items that WAND scores in full, of cursors over ascending items with an upper bound each."""
    now = [[items[0], k, 0] for k, (items, _) in enumerate(cursors)]
    while now:
        now.sort()
        total, pivot = rest, None
        for item, k, _ in now:
            total += cursors[k][1]
            if total >= threshold - 1e-9:
                pivot = item
                break
        if pivot is None:
            return
        score = now[0][0] == pivot
        if score:
            yield pivot
        target, left = pivot + score, []
        for c in now:
            items = cursors[c[1]][0]
            if c[0] < target:
                c[2] = bisect_left(items, target, c[2])
                if c[2] == len(items):
                    continue
                c[0] = items[c[2]]
            left.append(c)
        now = left


class Searcher:
    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.table = IntTable()
        if len(index.terms):
            self.table.insert(index.terms, np.arange(len(index.terms), dtype=np.int32))
        self.parts = lru_cache(4096)(self._parts)

    def _parts(self, k: int) -> tuple[set, set]:
        """Shingles of an item's question and answer."""
        w = self.index.words[self.index.word_begin[k] : self.index.word_begin[k + 1]]
        cut = max(1, min(len(w) - 1, 2 * len(w) // 3))
        return _shingles(w[:cut]), _shingles(w[cut:]) or _shingles(w[:cut])

    def search(self, texts: list[str]) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item id, passages, score, question overlap, answer overlap) of every match."""
        keys, doc = word_keys(texts)
        index = self.index
        if not len(keys) or not len(index.terms):
            return []
        stride = index.passage // 2
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        n = np.diff(begin)
        passages = np.maximum(1, -(-n // stride) - 1)  # of each text
        base = np.cumsum(passages) - passages
        term, missing = self.table.find(keys)
        known = np.ones(len(keys), bool)
        known[missing] = False
        at = np.flatnonzero(known)
        d, half = doc[at], (at - begin[doc[at]]) // stride
        # a word lies in the passage that begins in its half window and in the one before
        late = half < passages[d]
        early = half > 0
        place = np.concatenate([(base[d] + half)[late], (base[d] + half - 1)[early]])
        both = np.unique(place * np.int64(len(index.terms)) + np.concatenate([term[at][late], term[at][early]]))
        place, t = both // len(index.terms), both % len(index.terms)
        size = index.first[t + 1] - index.first[t]
        done = np.cumsum(size)
        posting = np.repeat(index.first[t] - done + size, size) + np.arange(int(done[-1]) if len(done) else 0)
        cell = np.repeat(place, size) * np.int64(len(index.rest)) + index.block[posting]
        cell, inverse = np.unique(cell, return_inverse=True)
        total = np.bincount(inverse, index.most[posting], len(cell))
        live = total + index.rest[cell % len(index.rest)] >= self.threshold - 1e-9
        mine = np.flatnonzero(live[inverse])
        mine = mine[np.argsort(inverse[mine], kind="stable")]
        if not len(mine):
            return []
        cut = np.flatnonzero(np.append(True, np.diff(inverse[mine]) != 0))
        found: dict[tuple[int, int], list] = {}
        held, sets = -1, (None, None)
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(mine)], strict=True):
            p, b = divmod(int(cell[inverse[mine[a]]]), len(index.rest))
            i = int(np.searchsorted(base, p, side="right")) - 1
            if p != held:
                lo = begin[i] + (p - base[i]) * stride
                window = keys[lo : min(lo + index.passage, begin[i + 1])]
                held, sets = p, (np.unique(window), None)
            rows = posting[mine[a:z]]
            cursors = [(index.post_item[x:y].tolist(), m) for x, y, m in zip(index.post_begin[rows].tolist(), index.post_begin[rows + 1].tolist(), index.most[rows].tolist(), strict=True)]
            for k in pivots(cursors, float(index.rest[b]), self.threshold):
                terms, impact = index.impacts(k)
                score = float(impact[np.isin(terms, sets[0], assume_unique=True)].sum())
                if score < self.threshold:
                    continue
                if sets[1] is None:
                    sets = (sets[0], _shingles(window) | {(x,) for x in sets[0].tolist()} | {tuple(window[j : j + 2].tolist()) for j in range(len(window) - 1)})
                q, a_ = (len(part & sets[1]) / len(part) for part in self.parts(k))
                if q >= self.overlap and a_ >= self.overlap:
                    row = found.setdefault((i, k), [0, 0.0, 0.0, 0.0])
                    row[0] += 1
                    row[1:] = max(row[1:], [score, q, a_])
        return [(i, index.ids[k], *row) for (i, k), row in sorted(found.items())]


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    """For each item with words its length (term null), and for each of its terms a row."""
    for _, texts in text_slices(batches):
        keys, doc = word_keys(texts)
        lengths = np.bincount(doc, minlength=len(texts))
        lengths = lengths[lengths > 0]
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys) != 0) | (np.diff(doc) != 0)
        terms = pa.array([None] * len(lengths) + keys[new].tolist(), pa.int64())
        yield pa.RecordBatch.from_arrays([terms, pa.array(lengths.tolist() + [0] * int(new.sum()), pa.int64())], names=["term", "words"])


def _shards(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """Indexes of all items, one shard at a time on the driver."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    counted = items.select("text").mapInArrow(_item_terms, "term long, words long").groupBy("term").agg(
        F.count("*").alias("items"), F.sum("words").alias("words"), F.max("words").alias("longest")
    )
    counted = stored(counted, "benchmark-terms")  # one row a term, and one of all lengths
    whole = counted.where("term IS NULL").first()

    def index(ids: list[int], texts: list[str]) -> Index:
        terms = pa.table({"term": np.unique(word_keys(texts)[0])})
        found = counted.join(F.broadcast(spark.createDataFrame(terms)), "term").select("term", "items").toArrow().sort_by("term")
        statistics = Statistics(whole["items"], whole["words"] / whole["items"], whole["longest"], found["term"].to_numpy(), found["items"].to_numpy()) if whole else None
        return Index.of(ids, texts, threshold, statistics)

    ids, texts, size = [], [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if len(ids) == ITEMS_PER_SHARD or (ids and size + len(row["text"]) > SHARD_CHARS):
            yield index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield index(ids, texts)
    drop_stored(counted)


MATCHES = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item of which a passage was found."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text"))
    out = None
    for index in _shards(benchmark, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value, threshold, overlap)
            for batch, texts in text_slices(batches):
                found = searcher.search(texts)
                columns = list(zip(*found, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                        *(pa.array(c, pa.float64()) for c in columns[3:]),
                    ],
                    names=["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"],
                )

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no item was found."""
    ship(docs.sparkSession)
    k = docs.columns.index("text")
    for index in _shards(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value, threshold, overlap)
            for rows, texts in text_slices(batches, column=k):
                keep = np.ones(len(texts), bool)
                for hit in searcher.search(texts):
                    keep[hit[0]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
