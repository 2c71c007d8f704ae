"""Word and shingle hashes of whole texts, as flat arrays."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Words of a shingle; a text of fewer words has one shingle of them all.
SHINGLE = 5
KEPT_WORDS = 300_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-cased words of all texts in one array, and the n + 1 bounds of the texts in it."""
        words = [WORD.findall(t.lower()) if t else () for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.uint64, bounds[-1]), bounds


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of width words; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0 or width <= 0:
        return hashes[:0]
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * ODD[j] + hashes[j : j + n]
    return mixed(out)


def shingles_of_text(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Shingles of one text; a text of fewer words has one of them all, a text without words none."""
    return shingles(hashes, min(width, len(hashes)))
