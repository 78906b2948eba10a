"""Words and their hashes in NumPy; a word is a run of anything but ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words, emptied when it holds more than ``most``: at some 180 bytes each, a few MB of a worker."""

    def __init__(self, most: int = 1 << 16):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words, in order; multilinear over the word hashes, then mixed."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total += h[k : k + n] * np.uint64(pow(_ODD, k + 1, 1 << 64))
    return mixed(total)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles after lower-casing A-Z; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(width, len(words))))
