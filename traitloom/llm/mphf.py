"""Minimal perfect hash of 64-bit keys in numpy arrays.

Each level is a bit array of ``GAMMA`` times the keys still open. Keys that are alone at their bit are placed there;
the others go on to the next level. A key's index is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2, 48


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """SplitMix64 finaliser over the key and the level."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64 values."""
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-max(GAMMA * len(keys), 64) // 64) * 64
            at = (mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys repeat")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view(np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key that was not built in, any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            bit = start + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, low = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> low & np.uint64(1)).astype(bool)
            under = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            out[open_[hit]] = (self.before[bit >> 6] + under)[hit]
            open_ = open_[~hit]
        return out
