"""Words and shingles as 64-bit numbers, inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 150_000
SHINGLE = 5

# Odd multipliers of the word positions in a shingle: random numbers, fixed once.
_POSITIONS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


class Recent(dict):
    """Results of ``make`` by text, looked up as fast as in a plain dict and bounded in number.

    When ``size`` results are held they become the older half: what is asked for again moves back, the rest goes
    with the next turn, so frequent texts stay. Texts longer than ``longest`` are made anew each time.
    """

    def __init__(self, make, size: int, longest: int) -> None:
        super().__init__()
        self.make, self.size, self.longest = make, size, longest
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordIds(dict):
    """Word bytes to 64-bit hashes; looking up is as fast as a plain dict. Bounded: it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def word_ids(text: bytes | None, ids: WordIds) -> np.ndarray:
    """Hashes of the words of a text: A-Z in lower case, split at ASCII white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; a shorter text is one run; none without words."""
    n = len(words)
    if n == 0:
        return words
    used = min(n, width)
    total = np.zeros(n - used + 1, dtype=np.uint64)
    for k in range(used):
        total += words[k : n - used + 1 + k] * _POSITIONS[k]
    return np.unique(mix64(total + np.uint64(used)))
