"""A generalised suffix automaton over integer sequences."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """States hold the sets of equal end places; `least` is the smallest owner among them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list[int | None] = [None]

    def _clone(self, p: int, q: int, word: int) -> int:
        c = len(self.length)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.least.append(None)
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: Sequence[int], owner: int) -> list[int]:
        """Adds one sequence; the state after each of its words."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last, states = 0, []
        for word in sequence:
            q = nxt[last].get(word)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, q, word)
                last = q
            else:
                new = len(length)
                nxt.append({})
                length.append(length[last] + 1)
                least.append(None)
                link.append(0)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
                last = new
            if least[last] is None or owner < least[last]:
                least[last] = owner
            states.append(last)
        return states

    def finish(self) -> list[int]:
        """Spreads `least` to shorter suffixes; the states from long to short."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        least, link = self.least, self.link
        for s in order:
            up = link[s]
            if up > 0 and (least[up] is None or least[s] < least[up]):
                least[up] = least[s]
        return order

    def statistics(self, sequence: Sequence[int]):
        """Matching statistics: after each word, the length of the longest suffix that occurs, and its state."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for word in sequence:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(word)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
            yield size, state

    def owner(self, state: int, size: int, window: int) -> int | None:
        """Smallest owner of the last `window` words of a match of `size` words that ended in `state`."""
        if size < window:
            return None
        while self.length[self.link[state]] >= window:
            state = self.link[state]
        return self.least[state]
