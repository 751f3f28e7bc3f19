"""Minimal perfect hashing of 64-bit keys, in arrays.

Keys are hashed into a bit array a little larger than their number; keys alone at their
position stay there, the others go on to the next, smaller array. A key's slot is the rank
of its bit over all arrays, so ``n`` keys get the slots 0 to ``n`` - 1. About three bits a
key are stored; the keys are not. Keys never seen get some slot or -1, so a caller keeps a
fingerprint per slot.
"""

from __future__ import annotations

import struct

import numpy as np

_SPACIOUS = 1.5
_MOST_LEVELS = 200


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A fresh 64-bit hash of 64-bit keys (finaliser of SplitMix64, a fixed function)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots of a fixed set of distinct keys; ``words`` and ``before`` hold bits and ranks of each level."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], size: int) -> None:
        self.levels, self.size = levels, size

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        """Built from distinct uint64 keys; a repeated key is an error."""
        left, levels, placed = keys.astype(np.uint64), [], 0
        while len(left):
            if len(levels) == _MOST_LEVELS:
                raise ValueError("keys are repeated")
            words = max(1, -(-int(len(left) * _SPACIOUS) // 64))
            at = (mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            levels.append((bits, placed + np.append(0, ranks[:-1])))
            placed += int(ranks[-1])
            left = left[~alone[at]]
        return cls(levels, len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key outside the set, any slot or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            if not len(todo):
                break
            at = (mixed(keys[todo], level) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, low = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << low) - np.uint64(1))
            out[todo[hit]] = (before[at >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QI", self.size, len(self.levels)) + b"".join(struct.pack("<Q", len(bits)) for bits, _ in self.levels)
        return head + b"".join(bits.astype("<u8").tobytes() + before.astype("<i8").tobytes() for bits, before in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        size, count = struct.unpack_from("<QI", data)
        lengths = struct.unpack_from(f"<{count}Q", data, 12)
        at, levels = 12 + 8 * count, []
        for n in lengths:
            levels.append((np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n)))
            at += 16 * n
        return cls(levels, size)
