"""DartMinHash signatures of weighted shingle sets, in numpy over many documents at once.

Each element of a set owns a strip of the plane: weight on one axis, rank on the other. Darts fall on
it as a Poisson process of rate 1, seeded by the element, each with a random signature coordinate.
A coordinate's value is its lowest dart inside the set's region. Only darts up to the rank that
gives about k (ln k + 3) darts for the set are thrown, so the work does not grow with k times the
size. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from .words import joined, mix, span_hashes, texts_of, word_spans

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Fraction bits of a dart's fixed-point rank.
_FRACTION = 29
_EMPTY = np.uint64((1 << 40) - 1)

# cumulative probabilities of a Poisson count with mean 1
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.array([1.0, *range(1, 14)])))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every shingle: five words, A-Z in lower case; shorter texts are one."""
    data, begins = joined([t.lower() if t.isascii() else _ascii_lower(t) for t in texts])
    starts, ends = word_spans(data)
    doc = texts_of(starts, begins)
    key = span_hashes(data, starts, ends).astype(np.uint64)
    n = np.bincount(doc, minlength=len(texts))
    m = len(key) - SHINGLE + 1
    out, of = [], []
    if m > 0:
        h = np.full(m, 17, np.uint64)
        for k in range(SHINGLE):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + key[k : m + k])
        whole = doc[:m] == doc[SHINGLE - 1 :]
        out.append(h[whole])
        of.append(doc[:m][whole])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        first = (np.cumsum(n) - n)[short]
        h = mix(n[short].astype(np.uint64))
        for k in range(SHINGLE - 1):
            has = n[short] > k
            h[has] = mix(h[has] * np.uint64(31) + key[first[has] + k])
        out.append(h)
        of.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def _ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def cells(hashes: np.ndarray, doc: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of the sets: one for each distinct shingle, or one for each occurrence (its weight).

    They are sorted by document; in a document by hash if not ``counted``.
    """
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    if not counted:
        return hashes[new], doc[new]
    first = np.flatnonzero(new)
    copy = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    return mix(hashes + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def signatures(cell: np.ndarray, doc: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """k values of each of n sets given as unit cells."""
    out = np.full(n * k, _EMPTY, np.uint64)
    if not len(cell):
        return out.reshape(n, k)
    size = np.bincount(doc, minlength=n)
    reach = k * (np.log(k) + 3) / np.maximum(size, 1)
    steps = np.ceil(reach).astype(np.int64)[doc]
    # one strip piece for each unit of rank
    done = np.cumsum(steps)
    unit = np.arange(int(done[-1])) - np.repeat(done - steps, steps)
    piece = mix(np.repeat(cell, steps) + (unit.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(doc, steps)
    count = np.searchsorted(_POISSON, _uniform(piece), side="right")
    done = np.cumsum(count)
    nth = np.arange(int(done[-1])) - np.repeat(done - count, count)
    dart = mix(np.repeat(piece, count) ^ ((nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)))
    owner, unit = np.repeat(owner, count), np.repeat(unit, count)
    fraction = dart >> np.uint64(64 - _FRACTION)
    inside = unit + fraction.astype(np.float64) / (1 << _FRACTION) <= reach[owner]
    dart, owner, unit, fraction = dart[inside], owner[inside], unit[inside], fraction[inside]
    place = owner.astype(np.uint64) * np.uint64(k) + (dart & np.uint64(0xFFFFFFFF)) % np.uint64(k)
    sortable = np.sort((place << np.uint64(40)) | (unit.astype(np.uint64) << np.uint64(_FRACTION)) | fraction)
    place = sortable >> np.uint64(40)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out[place[first].astype(np.int64)] = sortable[first] & _EMPTY
    return out.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, r])
    return h.astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets given as sorted distinct arrays."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 0.0
