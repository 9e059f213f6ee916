"""Quality rules: base rules and gradient-boosted trees over document statistics.

Statistics are computed for every document in one pass. The trees are fitted on a bounded sample of
labelled documents (``MOST_TRAINING_ROWS``, smallest hashes of doc_id first), with monotonic
constraints on chosen statistics, and flattened into node arrays that score whole batches at once.

Null or empty texts have no words and fail the base rules. Repeated rows each get their row. Labels
that are null are ignored; without both classes among the labels the trees keep everything. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_id_of, ship, stored, text_of, text_slices
from .words import IS_SPACE, joined, mix, span_hashes, texts_of, word_spans

#: Labelled documents that the trees are fitted on, at most.
MOST_TRAINING_ROWS = 20_000
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees read, and the direction in which the score may move with each:
#: -1 never up, 1 never down, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "exclamation_share": -1,
    "bare_symbol_words": -1,
    "distinct_word_share": 0,
    "same_as_last_share": -1,
    "stop_mark_share": 0,
    "words_per_line": 0,
}
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_LOWER[list(range(97, 123))] = True
_UPPER[list(range(65, 91))] = True
_DIGIT[list(range(48, 58))] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:")] = True


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text, all computed over whole texts."""
    n = len(texts)
    data, begins = joined(texts)
    starts, ends = word_spans(data)
    doc = texts_of(starts, begins)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[np.minimum(begins[1:] - 1, len(data))] - total[np.minimum(begins[:-1], len(data))]

    words = np.bincount(doc, minlength=n).astype(np.int64)
    chars = per_text(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[data])
    dup = np.zeros(n, np.int64)
    lines = np.ones(n, np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            rows = [r for r in t.split("\n") if r.strip(" \t\n\x0b\x0c\r")]
            dup[i] = len(rows) - len(set(rows))
            lines[i] = max(1, len(rows))
    key = span_hashes(data, starts, ends)
    repeat = _repeated_words(key, doc, n)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount(doc[_first_of(key, doc)], minlength=n)
    symbol_total = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    bare = (symbol_total[ends] - symbol_total[starts]) == ends - starts
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    upper, lower = per_text(_UPPER[data]), per_text(_LOWER[data])
    features = np.stack(
        [
            np.log1p(words),
            chars / w,
            symbols / c,
            dup / lines,
            repeat / w,
            upper / np.maximum(upper + lower, 1),
            per_text(_DIGIT[data]) / c,
            per_text(data == 33) / w,
            np.bincount(doc, bare, n) / w,
            distinct / w,
            np.bincount(doc, same, n) / w,
            np.bincount(doc, _STOP[data[ends - 1]], n) / w,
            words / lines,
        ],
        axis=1,
    )
    return np.stack([words, chars, symbols, dup, repeat], axis=1), features


def _first_of(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first word of each kind in each text."""
    both = mix(key.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(both, return_index=True)[1]


def _repeated_words(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text inside windows of WINDOW words that the text holds twice or more."""
    m = len(key) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    h = mix(doc[:m].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + key[k : m + k].astype(np.uint64))
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    _, group, size = np.unique(h[inside], return_inverse=True, return_counts=True)
    twice = inside[size[group] > 1]
    cover = np.zeros(len(key) + 1, np.int32)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    return np.bincount(doc, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)


@dataclass
class Trees:
    """Boosted trees as node arrays: child = left + (x[feature] > cut), leaves point to themselves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (x[row, self.feature[node]] > self.cut[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Logistic-loss boosting on histogram bins; a split that breaks a direction is not taken."""
    share = y.mean() if len(y) else 1.0
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(len(feature))
            # rows, node index, bounds of the leaf value
            todo = [(np.arange(len(y)), _new_node(feature, cut, left, value), -np.inf, np.inf, 0)]
            while todo:
                rows, node, low, high, level = todo.pop()
                leaf = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
                best = _best_split(binned, g, h, rows, edges, directions, least, ridge, low, high) if level < depth else None
                if best is None:
                    value[node] = rate * leaf
                    margin[rows] += value[node]
                    continue
                j, k, a, b = best
                feature[node], cut[node] = j, edges[j][k]
                left[node] = _new_node(feature, cut, left, value)
                _new_node(feature, cut, left, value)
                goes_left = binned[rows, j] <= k
                middle = (a + b) / 2
                la, ha = (low, middle) if directions[j] > 0 else (middle, high) if directions[j] < 0 else (low, high)
                lb, hb = (middle, high) if directions[j] > 0 else (low, middle) if directions[j] < 0 else (low, high)
                todo.append((rows[goes_left], left[node], la, ha, level + 1))
                todo.append((rows[~goes_left], left[node] + 1, lb, hb, level + 1))
    return Trees(base, np.array(feature, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(value, float), np.array(roots, np.int64), depth)


def _new_node(feature: list, cut: list, left: list, value: list) -> int:
    feature.append(0)
    cut.append(np.inf)
    left.append(len(left))
    value.append(0.0)
    return len(feature) - 1


def _best_split(binned, g, h, rows, edges, directions, least, ridge, low, high):
    """(feature, last bin on the left, left value, right value) of the largest gain."""
    best, most = None, 1e-6
    gs, hs = g[rows].sum(), h[rows].sum()
    for j, e in enumerate(edges):
        if not len(e):
            continue
        b = binned[rows, j]
        size = len(e) + 1
        n = np.cumsum(np.bincount(b, minlength=size))[:-1]
        gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
        gr, hr = gs - gl, hs - hl
        a, c = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
        gain = gl * a - (hl + ridge) * a * a / 2 + gr * c - (hr + ridge) * c * c / 2 - gs * gs / (hs + ridge) / 2
        bad = (n < least) | (len(rows) - n < least) | (directions[j] * (c - a) < 0)
        gain[bad] = -np.inf
        k = int(gain.argmax())
        if gain[k] > most:
            best, most = (j, k, float(a[k]), float(c[k])), gain[k]
    return best


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules, and the features of the trees."""
    ship(docs.sparkSession)

    def run(batches):
        for rows, texts in text_slices(batches):
            counts, features = statistics(texts)
            flat = pa.array(features.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), lists], names=["doc_id", *COUNTS, "features"])

    return docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, STATS)


def fit_on_labels(stats: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS, held_out_fold: int | None = 0) -> Trees:
    """Trees fitted on at most ``most`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    if held_out_fold is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != held_out_fold)
    # bounded: the smallest hashes go to the driver, then only these documents' statistics
    picked = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # of several rows with one id, the one with the least features: the same in every run
    rows = stats.select("doc_id", "features").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    rows = rows.toPandas().sort_values("doc_id")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["quality"].to_numpy(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, trees: Trees | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the trees' score of every row."""
    stats = stored(document_statistics(docs), "document-statistics")
    model = trees or fit_on_labels(stats, labels)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            score = shared.value.score(x)
            words, repeat = batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy()
            failed = (words < 20) | (100 * repeat > 30 * words)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")
