"""Shingle sets of texts as sorted 64-bit hashes, made in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
REMEMBERED = 150_000
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word met, computed once; forgets all when too many."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, A-Z lower-cased, split at ASCII white
    space; the whole sequence where there are fewer words; nothing for no words or NULL."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _HASHES.of(words)
    few = len(words) < n
    window, places = (len(words), 1) if few else (n, len(words) - n + 1)
    runs = np.full(places, np.uint64(window))
    for k in range(window):
        runs = runs * _K + hashes[k : k + places]
    return np.unique(mix(runs))


def set_class(hashes: np.ndarray) -> int | None:
    """A signed 64-bit name of a shingle set; None for the empty one."""
    return None if not len(hashes) else xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
