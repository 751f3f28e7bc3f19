"""Suffix arrays by linear grouping (U. Baier, Linear-time Suffix Sorting, 2016).

Phase one groups the suffixes by their Lyndon prefixes. Groups are visited in descending
order. For every suffix of the visited group, ``previous`` points to the nearest suffix
before it in a lower group; that suffix continues into this one, so it moves behind the
rest of its own group, the further the more suffixes of the visited group point to it.
Phase two walks the suffixes in order: those whose next smaller suffix is the present one
are reached by the pointers from the place before it, and each takes the next free place of
its group. Nothing is renamed and no smaller text is sorted.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def grouped(text: np.ndarray) -> tuple[list[int], list[int]]:
    """The group of each suffix (where it starts in the suffix array) and its pointer to the previous smaller suffix, -1 for none.

    The text ends with its smallest number, which stands nowhere else.
    """
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    starts = np.flatnonzero(np.append(True, sorted_text[1:] != sorted_text[:-1]))
    sizes = np.diff(np.append(starts, len(text)))
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(starts, sizes)
    size_at = np.zeros(len(text), np.int64)
    size_at[starts] = sizes
    where = np.empty(len(text), np.int64)
    where[order] = np.arange(len(text))
    items, place, group, size = order.tolist(), where.tolist(), first.tolist(), size_at.tolist()
    previous = [-1] * len(items)

    def move(j: int) -> None:
        """Puts one suffix behind the rest of its group, as a group of its own."""
        g = group[j]
        n = size[g]
        if n > 1:
            end, at = g + n - 1, place[j]
            other = items[end]
            items[at], place[other] = other, at
            items[end], place[j] = j, end
            size[g], size[end], group[j] = n - 1, 1, end

    end = len(items) - 1
    while end > 0:
        start = group[items[end]]
        if start == end:
            i = items[end]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                move(j)
        else:
            pointed = Counter()
            for i in sorted(items[start : end + 1]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = previous[j]
                previous[i] = j
                pointed[j] += 1
            pointed.pop(-1, None)
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, n in pointed.items():
                by_count.setdefault(n, {}).setdefault(group[j], []).append(j)
            for n in sorted(by_count, reverse=True):
                for g, moved in by_count[n].items():
                    if len(moved) == size[g]:
                        continue
                    if len(moved) == 1:
                        move(moved[0])
                        continue
                    size[g] -= len(moved)
                    fresh = g + size[g]
                    size[fresh] = len(moved)
                    # Those that stand in the front part change places with those of the back part that stay.
                    chosen = set(moved)
                    free = [x for x in items[fresh : fresh + len(moved)] if x not in chosen]
                    for j in moved:
                        at = place[j]
                        if at < fresh:
                            other = free.pop()
                            to = place[other]
                            items[at], place[other] = other, at
                            items[to], place[j] = j, to
                        group[j] = fresh
        end = start - 1
    return group, previous


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in ascending order; the text ends with its smallest number, which stands nowhere else."""
    group, previous = grouped(text)
    free = list(range(len(group)))  # of each group start, its next free place
    out = [-1] * len(group)
    out[0] = len(group) - 1
    open_ = bytearray(b"\x01" * len(group))
    open_[-1] = 0
    for x in range(len(group)):
        j = out[x] - 1
        while j >= 0 and open_[j]:
            g = group[j]
            at = free[g]
            out[at], free[g], open_[j] = j, at + 1, 0
            j = previous[j]
    return np.array(out, np.int64)
