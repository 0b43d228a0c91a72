"""Shingles of words as 64-bit hashes, on the workers."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hash of each word; emptied when full, so that its memory has a bound."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_hashes = WordHashes()


def words(text: bytes) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased: what bytes.split() and bytes.lower() do."""
    return text.lower().split()


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words; of the whole sequence, if it is shorter."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out + h[k : len(h) - n + 1 + k]) * _P
    out ^= out >> np.uint64(32)
    out *= _Q
    out ^= out >> np.uint64(29)
    return np.unique(out)
