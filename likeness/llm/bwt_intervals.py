"""Threshold-bounded interval expansion on the Burrows-Wheeler transform of many short strings.

The suffixes of the joined strings, with a separator after each, are ordered up to a depth beyond the
threshold. Breadth-first backward extension then visits the suffix intervals of ever longer strings;
an interval of length l + 1 whose right border has no value yet gives that border the common prefix
l (Beller, Gog, Ohlebusch and Schnattinger 2013). The expansion stops at the threshold: borders
without a value part suffixes that share at least that many symbols. A place counts only if all of
its ``threshold`` bytes lie in its own string.
"""

from __future__ import annotations

import numpy as np


END, SEPARATOR = 0, 1
#: Symbols that one sort key holds at first, nine bits each.
PACKED = 4


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys in ascending order; keys of few bits are sorted together with their place."""
    width = int(len(key)).bit_length()
    if bits + width > 63:
        return np.argsort(key)
    both = np.sort((key << width) | np.arange(len(key)))
    return both & ((1 << width) - 1)


def suffix_order(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, suffix order, places in it) of the joined strings, ordered by at least ``depth`` symbols."""
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    symbols = np.append(data.astype(np.int64) + 2, END)
    symbols[np.cumsum([len(s) + 1 for s in strings]) - 1] = SEPARATOR
    n = len(symbols)
    padded = np.append(symbols, np.zeros(PACKED, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = (key << 9) | padded[k : n + k]
    h, bits = PACKED, 9 * PACKED
    while True:
        order = _order(key, bits)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if h >= depth or new[-1] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:] + 1
        bits = int(n).bit_length()
        key, bits = (rank << bits) | after, 2 * bits
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return symbols, order, place


def repeated_starts(strings: list[bytes], threshold: int) -> np.ndarray:
    """Whether the ``threshold`` bytes at each place of the joined strings (with separators) occur twice."""
    symbols, order, place = suffix_order(strings, threshold)
    n = len(symbols)
    left = symbols[order - 1]  # the Burrows-Wheeler transform
    step = place[order - 1]  # where the suffix that is one symbol longer stands
    border = np.zeros(n + 1, bool)  # suffixes k - 1 and k have a common prefix that is known to be shorter
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n])
    for length in range(threshold):
        size = high - low
        done = np.cumsum(size)
        k = np.repeat(low - done + size, size) + np.arange(int(done[-1]))
        owner = np.repeat(np.arange(len(low)), size)
        if length:
            inner = left[k] > SEPARATOR  # no string of interest goes over a separator
            k, owner = k[inner], owner[inner]
            if not len(k):
                break
        to, symbol = step[k], left[k]
        by = _order(to, int(n).bit_length())
        to, symbol, owner = to[by], symbol[by], owner[by]
        first = np.ones(len(to), bool)
        first[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(first)
        new_low = to[begin]
        new_high = to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = ~border[new_high]
        if length == 0:
            fresh |= new_high == n  # the last interval of the first level is expanded as well
        border[new_high] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    out = np.zeros(n, bool)  # one place for each symbol and the end
    joint = np.flatnonzero(~border[1:n]) + 1
    out[order[joint]] = True
    out[order[joint - 1]] = True
    size = np.array([len(s) + 1 for s in strings])
    left_over = np.repeat(np.cumsum(size) - 1, size) - np.arange(n - 1)
    return out[:-1] & (left_over >= threshold)
