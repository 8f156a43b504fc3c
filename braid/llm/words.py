"""Words and word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

SHINGLE = 5

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash per run of `size` words; fewer words are one run, no words are none."""
    if not len(words):
        return words
    size, short = (size, 0) if len(words) >= size else (len(words), len(words))
    n = len(words) - size + 1
    out = np.full(n, short, dtype=np.uint64)
    for i in range(size):
        out = (out + words[i : i + n]) * _ODD[i % 5]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(shingles(word_hashes(text or b""), size))
