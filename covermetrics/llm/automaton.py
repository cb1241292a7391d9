"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations


class SuffixAutomaton:
    """States hold the classes of substrings with equal end positions; `count` is the number of occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, sequence, weight: int = 1) -> None:
        """Add one sequence; none of its substrings continues into another sequence."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += weight

    def _extend(self, last: int, symbol) -> int:
        nxt, link, length = self.next, self.link, self.length
        if symbol in nxt[last]:
            q = nxt[last][symbol]
            return q if length[q] == length[last] + 1 else self._split(last, symbol, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
        return new

    def _split(self, p: int, symbol, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.count.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = clone
            p = link[p]
        return clone

    def finish(self) -> SuffixAutomaton:
        """Carry occurrence counts up the suffix links; call once, after the last add."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def windows(self, sequence, width: int):
        """(end, state) of each window of `width` symbols that the automaton holds, by matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(symbol)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            while matched > width and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if matched >= width:
                yield end, state
