"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

A word's vector is the mean of the vectors of its hashed parts: the whole word, its byte n-grams of
three to five between word marks, its shape, and a mark for a word that repeats one of the words
just before it. A document's vector is the mean over its words, a softmax layer gives the classes.
Both are learned together. The layer is linear, so scoring adds one number for each word; words met
before are kept in a bounded table.

The model is fitted on a bounded sample of labelled rows (``MOST_TRAINING_ROWS`` documents with the
smallest hashes of doc_id outside the held-out fold; of rows with one doc_id the one with the smallest
text hash), each with all its words. The executors count the sample's words and hash their parts; the
driver gets those, not the texts. Scores read the text only. Null or empty
texts have the zero vector and get the score of the bias. Labels with null quality are ignored;
without both classes every score is the share of label 1 (1 without labels). Repeated rows each get
their row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, drop_stored, ship, stored, text_of, text_slices, tidy
from .words import IntTable, joined, mix, span_hashes, texts_of, word_spans

#: Labelled documents that the model is fitted on, at most.
MOST_TRAINING_ROWS = 3_000
BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
#: A word equal to one of this many words before it carries the repeat mark.
LOOK_BACK = 3
MOST_WORDS = 1_000_000

# classes of bytes in a word's shape: lower, upper, digit, above ASCII; other bytes stand for themselves
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def word_keys(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each word, key of each word with its repeat mark in the low bit)."""
    starts, ends = word_spans(data)
    doc = texts_of(starts, begins)
    key = span_hashes(data, starts, ends)
    again = np.zeros(len(key), bool)
    for k in range(1, LOOK_BACK + 1):
        again[k:] |= (key[k:] == key[:-k]) & (doc[k:] == doc[:-k])
    return starts, ends, doc, (key & ~np.int64(1)) | again


def word_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the parts of all words, number of parts of each word)."""
    lengths = ends - starts
    n = len(starts)
    # each word between marks: 0x01 word 0x02
    size = lengths + 2
    done = np.cumsum(size)
    first = done - size
    marked = np.zeros(int(done[-1]), np.uint64)
    inner = np.ones(len(marked), bool)
    inner[first] = inner[done - 1] = False
    marked[first], marked[done - 1] = 1, 2
    flat = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    marked[inner] = data[flat]
    word = np.repeat(np.arange(n), size)
    of, hashes = [], []
    for g in NGRAMS:
        m = len(marked) - g + 1
        if m <= 0:
            continue
        h = np.full(m, g, np.uint64)
        for k in range(g):
            h = h * np.uint64(0x100000001B3) + marked[k : m + k]
        inside = word[:m] == word[g - 1 :]
        of.append(word[:m][inside])
        hashes.append(mix(h[inside]))
    of.append(np.arange(n))
    hashes.append(span_hashes(data, starts, ends).astype(np.uint64))
    # the shape: runs of one class of bytes count once
    shape = _SHAPE[data[flat]]
    owner = np.repeat(np.arange(n), lengths)
    new = np.ones(len(shape), bool)
    new[1:] = (shape[1:] != shape[:-1]) | (owner[1:] != owner[:-1])
    place = np.cumsum(new)
    within = place - np.repeat(place[np.cumsum(lengths) - lengths], lengths)
    value = mix((shape + np.uint64(256) * within.astype(np.uint64))[new])
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner[new], value)
    of.append(np.arange(n))
    hashes.append(mix(total + np.uint64(77)))
    marks = np.flatnonzero(again)
    # the mark has a word's weight of parts: it stands for all that the word's own parts cannot tell
    of.extend([marks] * 4)
    hashes.extend([np.full(len(marks), 1000 + k, np.uint64) for k in range(4)])
    of, hashes = np.concatenate(of), np.concatenate(hashes)
    order = np.argsort(of, kind="stable")
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of, minlength=n)


@dataclass
class SubwordModel:
    """The difference of the two classes' logits for each bucket, and of the biases."""

    weight: np.ndarray
    bias: float

    def word_scores(self, data, starts, ends, again) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        parts, n = word_parts(data, starts, ends, again)
        return np.add.reduceat(self.weight[parts], np.cumsum(n) - n) / n


def counted_words(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct word keys of each text in ascending order, and how often it has them."""
    data, begins = joined(texts)
    _, _, doc, keys = word_keys(data, begins)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(keys[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def distinct_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word keys in ascending order, buckets of their parts, number of parts of each)."""
    data, begins = joined(texts)
    starts, ends, _, keys = word_keys(data, begins)
    distinct, at = np.unique(keys, return_index=True)
    if not len(distinct):
        return distinct, np.zeros(0, np.int32), np.zeros(0, np.int64)
    flat, n = word_parts(data, starts[at], ends[at], (distinct & 1).astype(bool))
    return distinct, flat.astype(np.int32), n


def fit(texts: list[str], labels: np.ndarray, **settings) -> SubwordModel:
    """``fit_words`` for texts that are at hand."""
    return fit_words(counted_words(texts), labels, *distinct_parts(texts), **settings)


def fit_words(
    documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, keys: np.ndarray, flat: np.ndarray, n: np.ndarray,
    steps: int = 800, rate: float = 1.5, batch: int = 32, seed: int = 7,
) -> SubwordModel:
    """Softmax over averaged subword vectors, fitted by mini-batch gradient descent.

    ``documents`` are word keys and counts; ``keys``, ``flat`` and ``n`` are the parts of all their words.
    """
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 1 - 1e-6
    prior = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return SubwordModel(np.zeros(BUCKETS), prior)
    documents = [(np.searchsorted(keys, k), c) for k, c in documents]
    begin = np.concatenate([[0], np.cumsum(n)])
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32), np.array([0.0, prior], np.float32)
    step = 0
    while step < steps:
        order = rng.permutation(len(documents))
        for at in range(0, len(order), batch):
            now = [documents[i] for i in order[at : at + batch]]
            y = labels[order[at : at + batch]]
            lengths = np.array([c.sum() for _, c in now])
            cell_doc = np.repeat(np.arange(len(now)), [len(k) for k, _ in now])
            used, cell_word = np.unique(np.concatenate([k for k, _ in now]), return_inverse=True)
            # weight of each distinct word of the batch in each document: its count over the length
            weight = (np.concatenate([c for _, c in now]) / np.maximum(lengths, 1)[cell_doc]).astype(np.float32)
            k = n[used]
            ends = np.cumsum(k)
            rows = flat[np.repeat(begin[used] - ends + k, k) + np.arange(int(ends[-1]) if len(ends) else 0)]
            hidden = np.zeros((len(now), DIMENSIONS), np.float32)
            if len(used):
                word_vectors = np.add.reduceat(vectors[rows], ends - k, axis=0) / k[:, None]
                for j in range(DIMENSIONS):
                    hidden[:, j] = np.bincount(cell_doc, word_vectors[cell_word, j] * weight, len(now))
            logits = hidden @ layer.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(now)), y] -= 1
            lr = rate * max(0.05, 1 - step / steps)
            back_hidden = p @ layer
            layer -= lr * (p.T @ hidden) / len(now)
            bias -= lr * p.mean(0)
            if len(used):
                per_word = np.stack([np.bincount(cell_word, weight * back_hidden[cell_doc, j], len(used)) for j in range(DIMENSIONS)], 1) / k[:, None]
                spread = np.repeat(per_word * (lr * 10 / len(now)), k, axis=0)
                for j in range(DIMENSIONS):
                    vectors[:, j] -= np.bincount(rows, spread[:, j], BUCKETS).astype(np.float32)
            step += 1
    return SubwordModel((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; the scores of words met before are kept."""

    def __init__(self, model: SubwordModel, most_words: int = MOST_WORDS):
        self.model, self.most = model, most_words
        self._clear()

    def _clear(self) -> None:
        self.table, self.values, self.known = IntTable(), np.zeros(1 << 16), 0

    def scores(self, texts: list[str]) -> np.ndarray:
        data, begins = joined(texts)
        starts, ends, doc, keys = word_keys(data, begins)
        if self.known > self.most:
            self._clear()
        word, missing = self.table.find(keys)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            values = self.model.word_scores(data, starts[at], ends[at], (new & 1).astype(bool))
            while self.known + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values))])
            self.values[self.known : self.known + len(new)] = values
            self.table.insert(new, np.arange(self.known, self.known + len(new), dtype=np.int32))
            self.known += len(new)
            word[missing], _ = self.table.find(keys[missing])
        total = np.bincount(doc, self.values[word], len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        return 1 / (1 + np.exp(-(total + self.model.bias)))


def held_out(doc_id) -> object:
    """Whether a document is in the held-out fold: crc32 of its id as text is 0 modulo 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS) -> SubwordModel:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = (
        known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    sample = stored(one.select("doc_id", "quality", "row.text"), "quality-sample")
    documents = sample.mapInArrow(_counted_rows, "doc_id long, quality int, keys array<long>, counts array<long>").toArrow().sort_by("doc_id")
    parts = sample.mapInArrow(_part_rows, "key long, parts array<int>").groupBy("key").agg(F.first("parts").alias("parts")).toArrow().sort_by("key")
    drop_stored(sample)
    words = [(k.values.to_numpy(), c.values.to_numpy()) for k, c in zip(documents["keys"], documents["counts"], strict=True)]
    lists = parts["parts"].combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    tidy(docs.sparkSession)
    model = fit_words(words, documents["quality"].to_numpy(), parts["key"].to_numpy(), flat, sizes)
    del words, documents, parts, lists, sizes, flat
    tidy(docs.sparkSession)
    return model


def _counted_rows(batches):
    for rows, texts in text_slices(batches):
        found = counted_words(texts)
        lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), *lists], names=["doc_id", "quality", "keys", "counts"])


def _part_rows(batches):
    for _, texts in text_slices(batches):
        keys, flat, n = distinct_parts(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "parts"])


_scorers: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model, with the words it has met."""
    key = hash((shared.value.bias, shared.value.weight.tobytes()))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: SubwordModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches):
        scorer = _scorer(shared)
        for rows, texts in text_slices(batches):
            scores = scorer.scores(texts)
            columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(doc_id_of(docs).alias("doc_id"), F.coalesce(held_out(doc_id_of(docs)), F.lit(False)).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: SubwordModel | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))
    k = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(shared)
        for rows, texts in text_slices(batches, column=k):
            yield rows.filter(pa.array(scorer.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
