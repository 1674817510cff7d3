"""Word shingles as 64-bit hashes, in numpy, for operators that compare whole sets inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_word = lru_cache(1 << 18)(xxhash.xxh64_intdigest)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    """Words as bytes, which Python lower-cases and splits as ASCII: A-Z only, and the white space from tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; the whole sequence as one with fewer words; empty without words."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = _mixed((x + h[i : i + n]) * np.uint64(MULTIPLIERS[i % len(MULTIPLIERS)]))
    return np.unique(x)


def alike(s: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of the other whole sets: 100 * intersection >= percent * union. No set is empty."""
    sizes, every = np.array([len(o) for o in others]), np.concatenate(others)
    hit = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(s) + sizes - common)
