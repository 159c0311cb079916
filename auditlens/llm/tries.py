"""Double-array tries over phrases of 64-bit words, advanced for all positions of a text at once."""

from __future__ import annotations

import numpy as np

# A word is two symbols of this many bits, so that a state has at most 1,024 followers and lies in a short range.
BITS = 10
SYMBOLS = 1 << BITS
# Different words a trie can tell apart; a phrase of k words brings at most k of them.
MOST_WORDS = 1 << (2 * BITS)
_ATTEMPTS = 12
_FREE = -1


class PhraseTrie:
    """Phrases of one length; ``base`` and ``check`` are the double array, ``accept`` numbers the phrases."""

    def __init__(self, phrases: np.ndarray) -> None:
        """``phrases``: distinct rows of words."""
        self.words, codes = np.unique(phrases, return_inverse=True)
        if len(self.words) > MOST_WORDS:
            raise ValueError("too many words for one trie")
        codes = codes.reshape(phrases.shape).astype(np.int64)
        symbols = np.empty((len(phrases), 2 * phrases.shape[1]), np.int64)
        symbols[:, 0::2] = codes >> BITS
        symbols[:, 1::2] = codes & (SYMBOLS - 1)
        order = np.lexsort(symbols.T[::-1])
        self.phrases = phrases[order]
        self._build(symbols[order])

    def _build(self, symbols: np.ndarray) -> None:
        """Level by level: the followers of a state go to free slots ``base + symbol`` that ``check`` ties to it."""
        draw = np.random.default_rng(len(symbols))
        self.base = np.zeros(4 * SYMBOLS, np.int32)
        self.check = np.full(4 * SYMBOLS, _FREE, np.int32)
        self.check[0] = 0
        top = SYMBOLS
        state = np.zeros(len(symbols), np.int64)
        for level in range(symbols.shape[1]):
            column = symbols[:, level]
            starts = run_starts(state, column)
            parents, follows = state[starts], column[starts]
            firsts = run_starts(parents)
            sizes = np.diff(np.append(firsts, len(parents)))
            slots = np.empty(len(starts), np.int64)
            for g in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:
                part = slice(firsts[g], firsts[g] + sizes[g])
                symbol = follows[part]
                self._reserve(top + 2 * SYMBOLS)
                for base in draw.integers(0, top, _ATTEMPTS):
                    if (self.check[base + symbol] == _FREE).all():
                        break
                else:
                    base = top - symbol[0]
                slots[part] = base + symbol
                self.check[slots[part]] = parents[part]
                self.base[parents[firsts[g]]] = base
                top = max(top, int(slots[part][-1]) + 1)
            single = firsts[sizes == 1]
            self._reserve(top + len(single) + 2 * SYMBOLS)
            slots[single] = top + np.arange(len(single))
            self.check[slots[single]] = parents[single]
            self.base[parents[single]] = slots[single] - follows[single]
            top += len(single)
            state = np.repeat(slots, np.diff(np.append(starts, len(symbols))))
        self.base, self.check = self.base[: top + SYMBOLS].copy(), self.check[: top + SYMBOLS].copy()
        self.accept = np.full(len(self.base), _FREE, np.int32)
        self.accept[state] = np.arange(len(state))

    def _reserve(self, slots: int) -> None:
        while len(self.base) < slots:
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, _FREE)])

    def occurrences(self, text: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, phrase numbers) where a phrase starts, among the positions ``at`` if given; no phrase holds
        the word 0, which separates pieces."""
        length = self.phrases.shape[1]
        at = np.arange(max(len(text) - length + 1, 0)) if at is None else at
        state = np.zeros(len(at), np.int64)
        for k in range(length):
            word = text[at + k]
            code = np.searchsorted(self.words, word)
            code[code == len(self.words)] = 0
            known = self.words[code] == word
            state, at, code = state[known], at[known], code[known]
            state, at, code = self._step(state, code >> BITS, at, code)
            state, at, code = self._step(state, code & (SYMBOLS - 1), at, code)
        return at, self.accept[state]

    def _step(self, state, symbol, at, code):
        """All positions one symbol on; those without a follower drop out."""
        slot = self.base[state] + symbol
        alive = self.check[slot] == state
        return slot[alive].astype(np.int64), at[alive], code[alive]


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)
