"""Words of UTF-8 bytes as spans, their hashes, and a hash table, all in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: Odd random multipliers of byte values and of places in a span.
BY_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BY_PLACE = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)

#: Bytes 0x09-0x0D and 0x20 part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def joined(texts: list[str], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a separator after each but the last, where each begins and the end)."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(separator.join(parts), np.uint8)
    begins = np.cumsum([0, *(len(p) + len(separator) for p in parts)])
    return data, begins


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run of bytes other than white space."""
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~IS_SPACE[data]
    change = np.diff(word)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def texts_of(starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Index of the text that holds each start; ``begins`` as from ``joined``."""
    each = np.diff(np.append(np.searchsorted(starts, begins[:-1]), len(starts)))
    return np.repeat(np.arange(len(begins) - 1), each)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hash of the bytes and length of each span (spans in order, none empty)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lengths = ends - starts
    done = np.cumsum(lengths)
    shift = np.repeat((starts - done + lengths).astype(np.int32), lengths)
    count = np.arange(int(done[-1]), dtype=np.int32)
    place = count - np.repeat((done - lengths).astype(np.int32), lengths)
    mixed = BY_BYTE[data[shift + count]] * BY_PLACE[place & 4095]
    if lengths.max() > 4096:  # a very long word: the block number counts too
        mixed ^= (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * mixed
    h = np.add.reduceat(mixed, done - lengths)
    return (mix(h + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)


class IntTable:
    """Open-addressing map from int64 keys to int32 values, looked up in whole arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.values, self.filled = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & np.int64(len(self.keys) - 1)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if (self.filled + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            k, v, slots = self.keys[old], self.values[old], len(self.keys)
            while (self.filled + len(keys)) * 3 > slots:
                slots *= 2
            self.__init__(slots)
            self.insert(k, v)
        self.filled += len(keys)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several that want one slot the last gets it
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places of the keys that are missing)."""
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        bad, missing = np.flatnonzero(found != keys), []
        while len(bad):
            gone = found[bad] < 0
            if gone.any():
                missing.append(bad[gone])
                bad = bad[~gone]
            at[bad] = (at[bad] + 1) & (len(self.keys) - 1)
            found[bad] = self.keys[at[bad]]
            out[bad] = self.values[at[bad]]
            bad = bad[found[bad] != keys[bad]]
        return out, np.concatenate(missing) if missing else bad
