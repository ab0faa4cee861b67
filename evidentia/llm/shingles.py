"""Word shingles of a text as sorted distinct 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """A number for each word; A-Z in lower case, words as bytes between the six white-space characters."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; with fewer words, the whole sequence as one.

    Two different shingles get the same number with a chance of 2**-64 each.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out ^= h[k : k + n]
        out *= _A
        out ^= out >> np.uint64(32)
        out *= _B
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_id(shingles: np.ndarray) -> int:
    """A 63-bit number for a set; sets that are equal have the same one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1
