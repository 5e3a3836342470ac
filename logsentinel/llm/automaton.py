"""Suffix automaton over integer tokens, with the first end of every state's substrings."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised: texts are added one after another; ``first_end`` of a state is where it was first seen."""

    __slots__ = ("next", "link", "length", "first_end", "_at")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first_end: list = [None]
        self._at = 0

    def _state(self, length: int, link: int, out: dict, end) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.first_end.append(end)
        return len(self.next) - 1

    def start_text(self) -> None:
        self._at = 0

    def extend(self, token, end) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self._at
        to = nxt[p].get(token)
        if to is not None:  # the substring is known from an earlier text
            if length[to] == length[p] + 1:
                self._at = to
            else:
                self._at = self._split(p, token, to)
            return
        cur = self._state(length[p] + 1, 0, {}, end)
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, token, q)
        self._at = cur

    def _split(self, p: int, token, q: int) -> int:
        nxt, link = self.next, self.link
        new = self._state(self.length[p] + 1, link[q], dict(nxt[q]), self.first_end[q])
        link[q] = new
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = new
            p = link[p]
        return new

    def matches(self, tokens, limit: int):
        """Matching statistics of tokens, capped at limit: for each token, the length of the longest known
        substring that ends there and the first end of that substring."""
        nxt, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        for token in tokens:
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(token)
            if to is not None:
                state, matched = to, matched + 1
            if matched > limit:
                matched = limit
            while state and length[link[state]] >= matched:
                state = link[state]
            yield matched, self.first_end[state]
