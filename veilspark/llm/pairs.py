"""A hash table from pairs of numbers to a number, looked up by whole arrays."""

from __future__ import annotations

import numpy as np

NO_PAIR = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed hash table from (left, right), both 0 to 2 ** 31 - 1, to a value below NO_PAIR."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32)
        todo, home, self.probes = np.arange(len(keys)), self._home(keys), 0
        while len(todo):
            slot = (home[todo] + self.probes) & self.mask
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            at = slot[free][first]
            self.keys[at], self.values[at] = keys[won], value[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values of pairs; NO_PAIR where there is none (padding is -1)."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(keys), NO_PAIR, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(keys[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)
