"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case; a word has no blank of ASCII in it."""
    return text.encode().lower().split()


class WordHashes(dict):
    """64-bit hashes by word, bounded; a worker keeps one."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(values: np.ndarray) -> np.ndarray:
    """A mixing permutation of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles in order; fewer words make one shingle, no words none."""
    n = len(hashes)
    if not n:
        return hashes
    taken = min(n, width)
    out = np.full(n - taken + 1, np.uint64(taken), np.uint64)
    for k in range(taken):
        out = finish(out * _MIX + hashes[k : n - taken + 1 + k])
    return out


def distinct_shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(hashes, width))
