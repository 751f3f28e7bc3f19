"""Which of many passages stand in which texts, character for character.

A passage is known by a window of its bytes, of the widest width of 1 to 64 it has room
for. The windows at all places of the texts are hashed side by side, each width from two of
half of it, and looked up among those of the passages; where one agrees, the passage itself
is searched for. Valid UTF-8 holds a text exactly where it holds the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WIDEST = 64
# Places hashed at once.
_PLACES = 1 << 16
_FIRST, _SECOND, _SLOT = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a window from those of its halves."""
    return left * _FIRST + (right ^ right >> np.uint64(32)) * _SECOND


def _masked(words: np.ndarray, width: int) -> np.ndarray:
    return words if width == 8 else words & np.uint64((1 << 8 * width) - 1)


def _hashes(windows: list[bytes], width: int) -> np.ndarray:
    """The hash of each window; all are of one width."""
    step = max(8, width)
    words = np.frombuffer(b"".join(w.ljust(step, b"\0") for w in windows), "<u8").reshape(len(windows), step // 8)
    words = _masked(words, min(8, width))
    while words.shape[1] > 1:
        words = _joined(words[:, ::2], words[:, 1::2])
    return words[:, 0]


class _Width:
    """The passages known by windows of one width."""

    def __init__(self, passages: list[tuple[int, bytes]], width: int) -> None:
        # Many passages may begin, or end, alike: of both windows the one that fewer share is taken.
        heads, tails = _hashes([p[:width] for _, p in passages], width), _hashes([p[-width:] for _, p in passages], width)
        rows, counts = np.unique(np.concatenate([heads, tails]), return_inverse=True, return_counts=True)[1:]
        shared = counts[rows].reshape(2, -1)
        by_tail = shared[1] < shared[0]
        self.keys, of = np.unique(np.where(by_tail, tails, heads), return_inverse=True)
        self.own: list[list[tuple[int, bytes, int]]] = [[] for _ in self.keys]
        for key, (number, passage), last in zip(of.tolist(), passages, by_tail.tolist()):
            self.own[key].append((number, passage, len(passage) - width if last else 0))
        bits = min(24, max(16, (64 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.taken = np.zeros(1 << bits, bool)
        self.taken[self._slots(self.keys)] = True

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * _SLOT >> self.shift).astype(np.int64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose window is a passage's, and the number of its key."""
        at = np.flatnonzero(self.taken[self._slots(hashes)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


class Passages:
    """Passages to be found in texts."""

    def __init__(self, passages: list[str | None]) -> None:
        self.empty: list[int] = []
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for number, passage in enumerate(passages):
            if passage:
                data = passage.encode()
                by_width.setdefault(min(_WIDEST, 1 << len(data).bit_length() - 1), []).append((number, data))
            elif passage is not None:
                self.empty.append(number)
        self.widths = {width: _Width(found, width) for width, found in by_width.items()}

    def held_by(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Pairs of a text and a passage that it holds, as numbers. A null text holds none, an empty passage is in every text.

        A pair may come again, and one passage's texts come in their order.
        """
        if self.empty:
            for text in np.flatnonzero(np.asarray(texts.is_valid())).tolist():
                yield from ((text, passage) for passage in self.empty)
        if not self.widths or not len(texts):
            return
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        bounds, held = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1], column.buffers()[2]
        whole = b"" if held is None else held.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes()
        bounds = bounds - bounds[0]
        for begin in range(0, len(whole), _PLACES):
            for width, at, key in self._found(whole, begin):
                text = np.searchsorted(bounds, at, "right") - 1
                inside = at + width <= bounds[text + 1]
                if inside.any():
                    yield from self._confirmed(whole, bounds, self.widths[width], text[inside], at[inside], key[inside])

    def _found(self, whole: bytes, begin: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, places, keys) of the windows that begin at ``begin`` or up to ``_PLACES`` behind."""
        most = max(self.widths)
        count = min(_PLACES, len(whole) - begin)
        data = whole[begin : begin + count + most + 16]
        data += b"\0" * (count + most + 16 - len(data))
        hashes = np.empty(-(-(count + most) // 8) * 8, np.uint64)
        for shift in range(8):
            hashes[shift::8] = np.frombuffer(data, "<u8", len(hashes) // 8, shift)
        for width in (1, 2, 4, 8):
            if width in self.widths:
                at, key = self.widths[width].places(_masked(hashes[:count], width))
                yield width, at + begin, key
        width = 8
        while width < most:
            hashes = _joined(hashes[:-width], hashes[width:])
            width *= 2
            if width in self.widths:
                at, key = self.widths[width].places(hashes[:count])
                yield width, at + begin, key

    @staticmethod
    def _confirmed(whole: bytes, bounds: np.ndarray, own: _Width, text: np.ndarray, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int]]:
        """The pairs of one text and key are searched once, between the first and the last place of their window."""
        both = text * len(own.keys) + key
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.diff(both[order], prepend=-1))
        ends = np.append(starts[1:], len(order)) - 1
        first, last = order[starts], order[ends]
        for t, k, low, high, begin, end in zip(*(a.tolist() for a in (text[first], key[first], at[first], at[last], bounds[text[first]], bounds[text[first] + 1]))):
            for number, passage, before in own.own[k]:
                if whole.find(passage, max(begin, low - before), min(end, high - before + len(passage))) >= 0:
                    yield t, number
