"""Weighted acyclic automata of phrases, held as sorted arrays of arcs.

The states of level k - 1 are phrases of k - 1 words. An arc of level k leaves the state of
a phrase's first k - 1 words, carries the state of its last k - 1 words as its symbol, and
weighs how often the phrase occurs. So a path from the start spells a phrase, its weights
are the counts of all its beginnings, and every symbol leads to the counts of its endings.
States are not merged by their futures, as almost no two carry the same weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CountAutomaton:
    """The arcs of one level in one range, ascending by (state, symbol), each once."""

    state: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray

    @classmethod
    def of_sorted(cls, state: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> CountAutomaton:
        """Built from sorted arcs, where equal ones stand side by side and their weights are added."""
        if not len(state):
            return cls(state, symbol, weight)
        fresh = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])))
        return cls(state[fresh], symbol[fresh], np.add.reduceat(weight, fresh))

    @classmethod
    def union(cls, parts: list[CountAutomaton]) -> tuple[CountAutomaton, list[np.ndarray]]:
        """One automaton with the summed weights, and where the arcs of each part stand in it."""
        state, symbol, weight = (np.concatenate([getattr(p, name) for p in parts]) for name in ("state", "symbol", "weight"))
        order = np.lexsort((symbol, state))
        s, y = state[order], symbol[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.append(False, (s[1:] != s[:-1]) | (y[1:] != y[:-1]))) if len(order) else 0
        ends = np.cumsum([len(p.state) for p in parts])[:-1]
        return cls.of_sorted(s, y, weight[order]), np.split(place, ends)

    def pruned(self, least: int) -> tuple[CountAutomaton, np.ndarray]:
        """Only arcs that weigh ``least`` or more, and the new place of every old arc, -1 for none."""
        stay = self.weight >= least
        return CountAutomaton(self.state[stay], self.symbol[stay], self.weight[stay]), np.where(stay, np.cumsum(stay) - 1, -1)
