"""A double-array trie over numbered symbols, whose states for many text positions advance together in numpy."""

from __future__ import annotations

import numpy as np

#: Places tried together for one node's children.
_PROBES = 64


class DoubleArray:
    """Phrases as states of a double array: the child of state s over symbol c is base[s] + c where check[base[s] + c] is s.

    `phrases` has one row per phrase, its symbols as 64-bit names, `lengths`
    how many of them count.  Every prefix of a phrase is a state too.  State 0
    is the root; `names` are the symbols in order, and symbol number c is
    names[c - 1].
    """

    def __init__(self, phrases: np.ndarray, lengths: np.ndarray):
        rows, width = phrases.shape
        inside = np.arange(width)[None, :] < lengths[:, None]
        self.names = np.unique(phrases[inside])
        codes = np.where(inside, np.searchsorted(self.names, phrases) + 1, 0)
        # plain trie: ids by level, node 0 is the root
        parent, code = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at, made = np.zeros(rows, np.int64), 1
        for k in range(width):
            deep = np.flatnonzero(lengths > k)
            if not len(deep):
                break
            pair = (at[deep] << 32) | codes[deep, k]
            new, place = np.unique(pair, return_inverse=True)
            parent.append(new >> 32)
            code.append(new & 0xFFFFFFFF)
            at[deep] = made + place
            made += len(new)
        self._place(np.concatenate(parent), np.concatenate(code))
        self.end = self.position[at]

    def _place(self, parent: np.ndarray, code: np.ndarray) -> None:
        nodes, symbols = len(parent), len(self.names)
        size = symbols + 1 + 3 * nodes
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.position = np.zeros(nodes, np.int64)
        taken = np.zeros(size, bool)
        taken[0] = True
        order = np.argsort(parent[1:], kind="stable") + 1
        owner, begin, count = np.unique(parent[order], return_index=True, return_counts=True)
        level_one = order[begin[0] : begin[0] + count[0]] if nodes > 1 else order
        bases = np.zeros(nodes, np.int64)
        self.position[level_one] = code[level_one]
        taken[code[level_one]] = True
        rng = np.random.default_rng(1)
        many = [i for i in np.argsort(-count, kind="stable") if count[i] > 1 and owner[i] != 0]
        for i in many:
            kids = order[begin[i] : begin[i] + count[i]]
            steps = code[kids]
            low, high = 1 - int(steps.min()), len(taken) - int(steps.max())
            tries = rng.integers(low, high, _PROBES)
            free = np.flatnonzero(~taken[tries[:, None] + steps[None, :]].any(1))
            if len(free):
                base = int(tries[free[0]])
            else:
                base = len(taken) - int(steps.min())
                taken = np.concatenate([taken, np.zeros(int(steps.max() - steps.min()) + 1, bool)])
            bases[owner[i]] = base
            self.position[kids] = base + steps
            taken[base + steps] = True
        single = np.flatnonzero((count == 1) & (owner != 0))
        kids = order[begin[single]]
        slots = np.flatnonzero(~taken)
        if len(slots) < len(kids):
            slots = np.concatenate([slots, len(taken) + np.arange(len(kids) - len(slots))])
        slots = slots[: len(kids)]
        bases[owner[single]] = slots - code[kids]
        self.position[kids] = slots
        size = max(len(taken), int(self.position.max()) + 1)
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[self.position] = bases
        self.check[self.position[1:]] = self.position[parent[1:]]

    def __len__(self) -> int:
        return len(self.check)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Number of each symbol; 0 for one that no phrase has."""
        if not len(self.names):
            return np.zeros(len(symbols), np.int64)
        at = np.minimum(np.searchsorted(self.names, symbols), len(self.names) - 1)
        return np.where(self.names[at] == symbols, at + 1, 0)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next state of every position at once; -1 where there is none.  A state of -1 stays so."""
        to = self.base[np.maximum(states, 0)] + codes
        able = (states >= 0) & (codes > 0) & (to >= 0) & (to < len(self.check))
        to[~able] = 0
        return np.where(able & (self.check[to] == states), to, -1)
