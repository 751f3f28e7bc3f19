"""Hashed word shingles of texts."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from gatelight.llm.perfect_hash import mixed

WORDS = 5


class Shingles:
    """Sets of 64-bit shingle hashes. Words are hashed once and remembered, within ``MOST`` words."""

    MOST = 300_000

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self.words) >= self.MOST:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """The distinct shingles of a text in ascending order: five words, or all words if they are fewer.

        Words are split at ASCII white space, A-Z in lower case.
        """
        get = self.words.get
        found = [get(w) or self._hash(w) for w in text.encode().lower().split()]
        n = len(found)
        if not n:
            return np.zeros(0, np.uint64)
        words = np.array(found, np.uint64)
        size = min(WORDS, n)
        # A chain of mixes, so that order and number of words count.
        out = np.full(n - size + 1, np.uint64(size), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = mixed(out ^ (words[i : n - size + 1 + i] * np.uint64(0x9E3779B97F4A7C15)), i + 1)
        return np.unique(out)
