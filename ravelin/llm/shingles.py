"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from ravelin.llm.common import ascii_words

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hash of each word seen in a task; emptied when it grows large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles of ``WIDTH`` words, sorted; fewer words are one shingle, none give none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(codes) - width + 1
    total = codes[:n] + np.uint64(width)
    for i in range(1, width):
        total = total * _STEP + codes[i : i + n]
    total = _mixed(total)
    total.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]
