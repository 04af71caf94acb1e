"""Hashes of many spans of one byte array at once, from differences of prefix sums."""

from __future__ import annotations

import numpy as np

PRIME = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit polynomial hashes of spans, and a second sum by which equal hashes of different spans are told apart."""

    def __init__(self) -> None:
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME))
        self.other = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(PRIME))
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            a = np.full(n, x, np.uint64)
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        self.power, self.inverse = powers(PRIME), powers(pow(PRIME, -1, 1 << 64))

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each span."""
        if len(data) >= len(self.power):
            self._grow(2 * len(data))
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def checks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A second number for each span."""
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.other[data], out=prefix[1:])
        return prefix[ends] - prefix[starts]


class SpanTable:
    """Rows of numbers by hash: a sorted array of hashes, with the check, and the place and length of each row in a pool."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget all rows."""
        self.hash, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't there."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, rows: list[np.ndarray]) -> None:
        """Add rows for hashes that are sorted and not there yet."""
        length = np.array([len(r) for r in rows], np.int64)
        total = int(length.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(2 * (self.used + total), np.uint32)))
        self.pool[self.used : self.used + total] = np.concatenate(rows) if rows else 0
        start = self.used + np.cumsum(length) - length
        self.used += total
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.check = np.insert(self.hash, at, hashes), np.insert(self.check, at, checks)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, length)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows at places one after the other, and their lengths."""
        length = self.length[places]
        before = np.cumsum(length) - length
        total = int(length.sum())
        return self.pool[np.repeat(self.start[places] - before, length) + np.arange(total)], length
