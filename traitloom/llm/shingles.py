"""Hashed word shingles."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included; fewer words: the whole sequence."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash_(joined, 42)], np.uint64)
    return np.array([hash_(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[width - 1 :])], np.uint64)
