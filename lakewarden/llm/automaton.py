"""A generalised suffix automaton over sequences of word numbers.

States are the classes of word runs that end at the same places in the items.
While a text is streamed, the state and the length of the longest suffix that
occurs in some item are kept; following links shortens the suffix. Adding items
one after another from the start state, with the two cases in which an edge
already exists handled apart, keeps every class minimal.

While it grows, a state is a dictionary of edges; once finished, states and
edges are flat arrays of numbers, some 40 bytes a word of the items.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Hashable, Sequence

import numpy as np


class SuffixAutomaton:
    """``add`` items, then ``finish``; afterwards it is read-only and can be pickled."""

    def __init__(self, window: int):
        self.window = window
        self.edges: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.items: list[Hashable] = []
        self.numbers: dict[Hashable, int] = {}
        self.owned: list[tuple[int, int]] = []  # (state, item) of whole windows
        self.short: dict[int, set[Hashable]] = {}

    def _state(self, size: int, edges: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the runs no longer than one word after ``state``."""
        copy = self._state(self.size[state] + 1, dict(self.edges[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.edges[state].get(word) == target:
            self.edges[state][word] = copy
            state = self.link[state]
        return copy

    def _step(self, last: int, word: int) -> int:
        if word in self.edges[last]:
            target = self.edges[last][word]
            return target if self.size[target] == self.size[last] + 1 else self._split(last, word, target)
        new = self._state(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.edges[state]:
            self.edges[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.edges[state][word]
            self.link[new] = target if self.size[target] == self.size[state] + 1 else self._split(state, word, target)
        return new

    def add(self, item: Hashable, words: Sequence[int]) -> None:
        if not words:
            return
        last = 0
        ends = []
        for word in words:
            last = self._step(last, word)
            ends.append(last)
        if len(words) < self.window:
            self.short.setdefault(last, set()).add(item)
        else:
            if item not in self.numbers:
                self.numbers[item] = len(self.items)
                self.items.append(item)
            # Later splits can only move a prefix's class to a longer-suffix state below which it stays reachable by links.
            self.owned += [(state, self.numbers[item]) for state in ends[self.window - 1 :]]

    def finish(self) -> None:
        """Flatten, give each window's items to the state that holds exactly it, and note the short items on each state's link path."""
        n = len(self.size)
        holder, next_short = list(range(n)), [-1] * n
        for state in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[state]
            next_short[state] = state if state in self.short else next_short[up]
            if self.size[up] >= self.window:
                holder[state] = holder[up]
        self.width = 1 + max((max(e) for e in self.edges if e), default=-1)
        edges = sorted((state * self.width + word, target) for state, e in enumerate(self.edges) for word, target in e.items())
        self.keys, self.targets = array("q", [k for k, _ in edges]), array("i", [t for _, t in edges])
        self.link, self.size, self.holder, self.next_short = (array("i", x) for x in (self.link, self.size, holder, next_short))
        owned = np.array(self.owned, np.int64).reshape(-1, 2)
        pairs = np.unique(np.array(holder)[owned[:, 0]] * max(len(self.items), 1) + owned[:, 1])
        self.owner_of, self.owner = (array("i", x.tolist()) for x in np.divmod(pairs, max(len(self.items), 1)))
        del self.edges, self.owned, self.numbers

    def find(self, words: Sequence[int]) -> tuple[list[tuple[int, int]], set[Hashable]]:
        """Spans [start, end) of words covered by windows, merged, and the items whose windows occur.

        A word below 0 is in no item.
        """
        keys, targets, width, last = self.keys, self.targets, self.width, len(self.keys)
        link, size, window, short, next_short = self.link, self.size, self.window, self.short, self.next_short
        state = length = 0
        spans: list[tuple[int, int]] = []
        found: set[Hashable] = set()

        def cover(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        for at, word in enumerate(words):
            if not 0 <= word < width:
                state = length = 0
                continue
            while True:
                key = state * width + word
                place = bisect_left(keys, key)
                if place < last and keys[place] == key:
                    state = targets[place]
                    length += 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = size[state]
            if length >= window:
                found |= self._owners(self.holder[state])
                cover(at + 1 - window, at + 1)
            small = next_short[state]
            while small > 0:
                if size[small] <= length:
                    found |= short[small]
                    cover(at + 1 - size[small], at + 1)
                small = next_short[link[small]]
        return spans, found

    def _owners(self, state: int) -> set[Hashable]:
        a, b = bisect_left(self.owner_of, state), bisect_left(self.owner_of, state + 1)
        return {self.items[k] for k in self.owner[a:b]}
