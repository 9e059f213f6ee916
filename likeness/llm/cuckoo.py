"""Cuckoo filter over 64-bit keys: insertion, deletion, vectorised lookup, bounded size."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """16-bit fingerprints, four to a bucket; built for its keys up to ``most_buckets``.

    A filter that cannot take one more key lets every key pass from then on: it has no false
    negatives, and the exact table behind it decides.
    """

    def __init__(self, buckets: int = 64, most_buckets: int = 1 << 16):
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.most, self.saturated = most_buckets, False
        self._rng = np.random.default_rng(buckets)

    @classmethod
    def of(cls, keys: np.ndarray, most_buckets: int = 1 << 16) -> CuckooFilter:
        """A filter sized for ``keys``; doubled until all fit or the bound is reached."""
        buckets = 64
        while buckets < most_buckets and len(keys) > 0.9 * SLOTS * buckets:
            buckets *= 2
        while True:
            out = cls(buckets, most_buckets)
            if all(out.insert(int(k)) for k in keys):
                return out
            if buckets >= most_buckets:
                out.saturated = True
                return out
            buckets *= 2

    def _places(self, key: int) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = (key >> 48) & 0xFFFF or 1
        first = key & mask
        return mark, first, first ^ self._other(mark)

    def _other(self, mark: int) -> int:
        return ((mark * 0x5BD1E995) >> 7) & (len(self.table) - 1)

    def insert(self, key: int) -> bool:
        if self.saturated:
            return True
        mark, a, b = self._places(key & 0xFFFFFFFFFFFFFFFF)
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = a
        for _ in range(KICKS):
            slot = int(self._rng.integers(SLOTS))
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= self._other(mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        self.saturated = True  # a mark is left over: from now on every key may be in
        return False

    def delete(self, key: int) -> bool:
        """Take out one copy of a key that was inserted."""
        if self.saturated:
            return True
        mark, a, b = self._places(key & 0xFFFFFFFFFFFFFFFF)
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in; no key that was inserted is missed."""
        if self.saturated:
            return np.ones(len(keys), bool)
        keys = keys.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        mark = (keys >> np.uint64(48)) & np.uint64(0xFFFF)
        mark[mark == 0] = 1
        a = keys & mask
        b = a ^ (((mark * np.uint64(0x5BD1E995)) >> np.uint64(7)) & mask)
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[a] == mark).any(1) | (self.table[b] == mark).any(1)

    def to_bytes(self) -> bytes:
        return bytes([self.saturated]) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, most_buckets: int = 1 << 16) -> CuckooFilter:
        out = cls(1, most_buckets)
        out.table = np.frombuffer(raw, np.uint16, offset=1).reshape(-1, SLOTS).copy()
        out.saturated = bool(raw[0])
        return out
