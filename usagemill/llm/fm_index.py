"""An FM-index over a shard of numbered words: backward search by wavelet ranks, places by sampled suffixes."""

from __future__ import annotations

import numpy as np

from usagemill.llm.tables import spread

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width *= 2


class WaveletRanks:
    """How often a symbol occurs before a place, over a bit matrix with a level for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(symbols) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for depth, level in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[depth], self.zeros[depth]
            bit = (symbol >> level) & 1 == 1
            ones_at, ones_from = ones[place], ones[start]
            place = np.where(bit, zeros + ones_at, place - ones_at)
            start = np.where(bit, zeros + ones_from, start - ones_from)
        return place - start


class FMIndex:
    """``symbols`` are whole numbers from 0 up."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols.astype(np.int64) + 1, 0)  # 0 ends the shard and sorts first
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.ranks = WaveletRanks(self.last)
        sampled = order % SAMPLE == 0
        self.sample = np.where(sampled, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each phrase; phrases are rows, aligned to the right."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        known = len(self.before) - 1
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[lengths[live] > step]
            symbol = phrases[live, width - 1 - step] + 1
            inside = symbol < known
            high[live[~inside]] = low[live[~inside]] = 0
            live, symbol = live[inside], symbol[inside]
            base = self.before[symbol]
            low[live] = base + self.ranks.rank(symbol, low[live])
            high[live] = base + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of some ranks start: steps back to a sampled suffix, counted."""
        found = np.full(len(rows), -1, np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            known = self.sample[at] >= 0
            found[open_[known]] = self.sample[at[known]] + steps
            open_, at = open_[~known], at[~known]
            symbol = self.last[at]
            at = self.before[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return found

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and start of every occurrence."""
        low, high = self.search(phrases, lengths)
        counts = high - low
        return np.repeat(np.arange(len(phrases)), counts), self.locate(spread(low, counts))
