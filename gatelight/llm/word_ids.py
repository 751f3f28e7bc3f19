"""Ids of whole texts by the tokenizers library, remembered word by word.

The tokenizers read here drop white space and never merge across it, so a text's ids are
those of its words one after another. Each distinct word goes through the library once per
worker. Texts with separators on which Python splits and the library does not go through
the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa

_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+)([.,;:!?*$%#&|]*)")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The sign that byte-level vocabularies write for each byte: itself where it prints, else the next from 256 on.
_BYTE_SIGNS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_LETTER_SIGNS = {c: "".join(_BYTE_SIGNS[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}
assert sys.byteorder == "little"


class WordIds(dict):
    """Words to the little-endian uint32 bytes of their ids.

    Two generations of words are remembered, at most ``MOST`` each; that bounds memory and
    changes no result.
    """

    MOST, LONGEST = 500_000, 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        apart = [i for w in "ab" for i in self.library.encode(w, add_special_tokens=False).ids]
        if self.library.encode("a b", add_special_tokens=False).ids != apart:
            raise ValueError("this tokenizer keeps white space; its words are not independent")
        # Latin letters with ASCII signs behind them are two pre-tokens of the byte-level kind
        # read here: the library's model takes them without the steps before it. Tried on samples.
        self.parts: dict[str, bytes] = {}
        self.model_tokens = self.library.model.tokenize
        self.simple = all(self._simple(w) == self._whole(w) for w in ("ab", "Über.", "ñandú***", "x,", "ABC!!", "éÀ"))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, word: str) -> bytes | None:
        """The ids of Latin letters with ASCII signs behind them, straight from the model; nothing for other words."""
        hit = _SIMPLE.fullmatch(word)
        if hit is None:
            return None
        core, signs = hit.groups()
        core = core.lower()
        if not core.isascii():
            core = core.translate(_LETTER_SIGNS)
        ids = self.parts.get(core) or self._part(core)
        return ids + (self.parts.get(signs) or self._part(signs)) if signs else ids

    def _part(self, part: str) -> bytes:
        ids = array("I", [t.id for t in self.model_tokens(part)]).tobytes()
        if len(self.parts) >= self.MOST:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._simple(word) if self.simple else None
        if ids is None:
            ids = self._whole(word)
        if len(self) >= self.MOST:
            self.older = dict(self)
            self.clear()
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Drops all remembered words; the library stays."""
        for held in (self, self.older, self.parts):
            held.clear()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        if _PYTHON_ONLY.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory per worker and file, until another operator's task calls :func:`forget_words`."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def forget_words() -> None:
    """Gives back the memory of words that tokenizing tasks have left in this worker.

    Workers outlive their tasks, so operators that follow in the same session call this first:
    a million remembered words take about 180 MB of a worker that has no more use for them.
    """
    held = [own for own in _made.values() if own or own.older or own.parts]
    for own in held:
        own.forget()
    if held:
        pa.default_memory_pool().release_unused()
