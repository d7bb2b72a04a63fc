"""Array-backed maps for vectorised lookups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text import find, ragged

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Fixed map from distinct non-negative int64 keys to int32 values: open addressing, looked up many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot the last stays
            put = self.keys[slot[left]] == keys[left]
            self.values[slot[left[put]]] = values[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


def groups(hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct first hashes, an index of each, the group of each span, and which spans aren't those of their group by the second hash."""
    some, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    return some, first, at, others != others[first][at]


class SpanCache:
    """Remembers a list of int32 for each span, known by two 64-bit hashes. ``make`` computes those of new spans; past ``most`` spans it starts afresh.

    A span whose first hash is that of another is never taken for it: it is computed each time.
    """

    def __init__(self, most: int = 400_000):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.others = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _add(self, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Starts of lists put in the pool."""
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, values.astype(np.int32)])
        return starts

    def lists(self, hashes: np.ndarray, others: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes) in ``pool`` of the list of each span. ``make`` gets indexes of spans and gives (sizes, concatenated lists)."""
        some, first, at, odd = groups(hashes, others)
        if len(self.keys) + len(some) > self.most:
            self._empty()
        known = find(self.keys, some)
        new = np.flatnonzero(known < 0)
        if len(new):
            sizes, values = make(first[new])
            where = np.searchsorted(self.keys, some[new])
            self.keys = np.insert(self.keys, where, some[new])
            self.others = np.insert(self.others, where, others[first[new]])
            self.starts = np.insert(self.starts, where, self._add(sizes, values))
            self.sizes = np.insert(self.sizes, where, sizes)
            known = find(self.keys, some)
        odd |= (self.others[known] != others[first])[at]
        starts, sizes = self.starts[known][at], self.sizes[known][at]
        if odd.any():
            n, values = make(np.flatnonzero(odd))
            starts[odd], sizes[odd] = self._add(n, values), n
        return starts, sizes

    def take(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.pool[ragged(starts, sizes)]
