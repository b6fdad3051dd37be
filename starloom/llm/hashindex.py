"""Lookup of many 64-bit keys at once in a fixed set of keys."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """Position of each key in ``keys``; keys must be distinct. Built once, read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at = self.slot(self.keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.slots[at] != np.arange(len(keys)))  # another key has their slot
        order = np.argsort(self.keys[lost])
        self.lost, self.lost_at = self.keys[lost][order], lost[order].astype(np.int32)
        self.padded = np.append(self.keys, np.uint64(0))  # what slot -1 reads
        self.empty = not len(keys)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key isn't there."""
        if self.empty:
            return np.full(len(keys), -1, np.int32)
        keys = keys.astype(np.uint64, copy=False)
        at = self.slots[self.slot(keys)]
        bad = np.flatnonzero((self.padded[at] != keys) | (at < 0))
        at[bad] = -1
        if len(bad) and len(self.lost):
            spot = np.minimum(np.searchsorted(self.lost, keys[bad]), len(self.lost) - 1)
            at[bad] = np.where(self.lost[spot] == keys[bad], self.lost_at[spot], -1)
        return at
