"""Words of texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes each worker keeps; a full cache is renewed from the words in use.
CACHE_ENTRIES = 200_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept while they are in use."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        number = self.older.get(word)
        if number is None:
            number = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and all other characters as they are."""
    return (text or "").encode().lower().split()


def mix(numbers: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; equal numbers stay equal and others stay apart."""
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A number per run of ``size`` words, in order; its length takes part."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    numbers = np.full(count, size, np.uint64)
    for place in range(size):
        numbers = mix(numbers * MULTIPLIER + hashes[place:place + count])
    return numbers


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, no words give none."""
    return np.unique(ngrams(hashes, min(size, len(hashes)))) if len(hashes) else hashes
