"""An Aho-Corasick automaton over byte strings that reads many strings at once.

Strings lie one after the other in a byte buffer, the longest first. At each step the automaton takes the next byte
of every string that is long enough; the states of all strings are one numpy array. Patterns that end at a byte are
met along output links, the longest first. What an array holds is bounded by the bytes of a batch, not by
(strings x longest string).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Automaton:
    """``own[state]``: the pattern that a state ends, or -1; ``link[state]``: the next shorter suffix that ends a pattern, or 0."""

    def __init__(self, patterns: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for pattern, number in patterns.items():
            at = 0
            for byte in pattern:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][byte]
            own[at] = number
        self.own, self.depth = np.array(own, dtype=np.int32), np.array(depth, dtype=np.int32)
        self.goto = np.zeros((len(own), 256), dtype=np.uint16 if len(own) <= 1 << 16 else np.int32)  # the largest part of a worker's memory
        self.link = np.zeros(len(own), dtype=np.int32)
        fail = np.zeros(len(own), dtype=np.int32)
        level = [0]
        while level:
            below = []
            for at in level:
                row = self.goto[at]
                if at:
                    row[:] = self.goto[fail[at]]
                for byte, child in children[at].items():
                    fail[child] = row[byte]
                    f = fail[child]
                    self.link[child] = f if own[f] >= 0 else self.link[f]
                    row[byte] = child
                    below.append(child)
            level = below

    def read(self, strings: Strings) -> Iterator[tuple[int, np.ndarray]]:
        """After each byte: its position, and the state of each string that has it (the first rows of ``strings``)."""
        state = np.zeros(len(strings.length), dtype=np.int32)
        for i in range(int(strings.length[0]) if len(state) else 0):
            n = strings.longer_than(i)
            state = self.goto[state[:n], strings.data[strings.start[:n] + i]]
            yield i, state

    def outputs(self, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``state`` and the node of a pattern that ends there; each row's longest comes first."""
        node = np.where(self.own[state] >= 0, state, self.link[state])
        rows = np.flatnonzero(node)
        node = node[rows]
        while len(rows):
            yield rows, node
            node = self.link[node]
            more = node > 0
            rows, node = rows[more], node[more]


class Strings:
    """Byte strings sorted by length, the longest first. ``order[k]`` is the place that string k of the input has got.

    Each string has ``length + 1`` slots in a flat array of slots, one for each prefix; ``slot[k]`` is its first.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        length = np.diff(offsets).astype(np.int64)
        by = np.argsort(-length, kind="stable")
        self.order = np.empty_like(by)
        self.order[by] = np.arange(len(by))
        self.data, self.start, self.length = data, offsets[:-1].astype(np.int64)[by], length[by]
        self.slot = np.concatenate([[0], np.cumsum(self.length + 1)])
        self._ascending = -self.length

    def longer_than(self, i: int) -> int:
        return int(np.searchsorted(self._ascending, -i, side="left"))
