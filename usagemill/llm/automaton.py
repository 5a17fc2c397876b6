"""A suffix automaton of many sequences of numbered words, and matching statistics over it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """States are classes of substrings with the same ends; each knows the first place at which it ended.

    Sequences are added in the order in which their places count as earlier; ``first`` of a state is the number, over
    all symbols added, of the symbol at which its strings ended first.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]
        self.symbols = 0

    def add(self, sequence: Sequence[int]) -> None:
        following, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        place = self.symbols
        for symbol in sequence:
            known = following[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                last = known  # the sequence so far has occurred before, at an earlier place
                place += 1
                continue
            if known is not None:
                last = self._clone(last, symbol, known)
                place += 1
                continue
            new = len(length)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(place)
            state = last
            while state >= 0 and symbol not in following[state]:
                following[state][symbol] = new
                state = link[state]
            if state >= 0:
                other = following[state][symbol]
                link[new] = other if length[other] == length[state] + 1 else self._clone(state, symbol, other)
            last = new
            place += 1
        self.symbols = place

    def _clone(self, state: int, symbol: int, other: int) -> int:
        following, link, length, first = self.next, self.link, self.length, self.first
        clone = len(length)
        following.append(following[other].copy())
        link.append(link[other])
        length.append(length[state] + 1)
        first.append(first[other])
        link[other] = clone
        while state >= 0 and following[state].get(symbol) == other:
            following[state][symbol] = clone
            state = link[state]
        return clone

    def matches(self, sequence: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
        """For each symbol: the length, ``limit`` at most, of the longest match that ends there, and its first end."""
        following, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                size = length[state]
            onward = following[state].get(symbol)
            if onward is None:
                yield 0, -1
                continue
            state, size = onward, size + 1
            while length[link[state]] >= limit:
                state = link[state]
            if size > limit:
                size = limit
            yield size, first[state]
