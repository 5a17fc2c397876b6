"""A gap-weighted subsequence kernel on words, as sparse features of three letters in order.

The feature of three letters is the sum, over all places where they occur in this order, of DECAY to the power of the
characters between them, however many; a word of one or two letters has one feature, of all of them. The kernel of two
words is the inner product of their features over the product of their norms, so a factor that all features of a word
share does not matter. Digits and signs are gaps: they carry no feature, so inserted characters lower a word's
similarity little. Letters of any script count; features are numbered by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from usagemill.llm.tables import by_length, offsets

DECAY = 0.6
FEATURES_LOG2 = 20
# A word of more letters than LONGEST is cut into pieces of PIECE letters that overlap by half, and takes the largest of
# their scores: a word of n letters has n^3 / 6 triples, a run of letters without spaces 37 for each letter.
LONGEST, PIECE = 24, 12
CELLS = 1 << 20  # features of words, or codes, that are worked on at once
TABLE_CELLS = 1 << 25  # values of a feature table that a Gram matrix is computed with

_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=None)
def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=None)
def _places(letters: int) -> np.ndarray:
    """The first, second and third of all triples of so many letters."""
    return np.array(list(combinations(range(letters), 3)), np.int64).T


@dataclass
class FeatureTable:
    """A row of values for each feature in use: feature number f has row ``index[f]``, row 0 is nothing.

    ``letters`` tells of each code point whether it is in any feature in use.
    """

    index: np.ndarray
    values: np.ndarray
    letters: np.ndarray


class WordKernel:
    def features(self, words: list[str], letters_in_use: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of equally many letters, feature numbers and weights (a row of each per word); weight 0 is no feature.

        With ``letters_in_use`` words are left out that have too few of these letters for any of their features.
        """
        for rows, codes in by_length(words):
            step = max(1, min(1 << 12, CELLS // codes.shape[1]))
            for start in range(0, len(rows), step):
                part, own = rows[start : start + step], codes[start : start + step]
                found = _letter_table()[own]
                counts = found.sum(axis=1)
                if letters_in_use is not None:
                    able = (letters_in_use[own] & found).sum(axis=1) >= np.minimum(counts, 3)
                    part, own, found, counts = part[able], own[able], found[able], counts[able]
                letters, places = own[found].astype(np.uint64), np.nonzero(found)[1]
                begins = offsets(counts)[:-1]
                for count in np.unique(counts[counts > 0]).tolist():
                    chosen = np.flatnonzero(counts == count)
                    size = max(1, CELLS // max(1, count * (count - 1) * (count - 2) // 6))
                    for at in range(0, len(chosen), size):
                        some = chosen[at : at + size]
                        cells = begins[some][:, None] + np.arange(count)
                        yield part[some], *self._of(letters[cells], places[cells])

    def _of(self, letters: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if letters.shape[1] < 3:
            short = np.zeros((len(letters), 3), np.uint64)
            short[:, : letters.shape[1]] = letters
            return self._number(*short.T)[:, None], np.ones((len(letters), 1), np.float32)
        i, j, k = _places(letters.shape[1])
        spans = places[:, k] - places[:, i]
        near = (places[:, 2:] - places[:, :-2]).min(axis=1, keepdims=True)
        weights = np.power(np.float32(DECAY), (spans - near).astype(np.float32))
        return self._number(letters[:, i], letters[:, j], letters[:, k]), weights

    @staticmethod
    def _number(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        mixed = ((a << np.uint64(42)) | (b << np.uint64(21)) | c) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        return (mixed >> np.uint64(64 - FEATURES_LOG2)).astype(np.int32)

    @staticmethod
    def norms(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Length of each row's feature vector; a feature that occurs more than once is summed first."""
        order = np.argsort(numbers, axis=1)
        number, weight = np.take_along_axis(numbers, order, 1), np.take_along_axis(weights, order, 1)
        total = np.cumsum(weight, axis=1, dtype=np.float64)
        last = np.concatenate([number[:, 1:] != number[:, :-1], np.ones((len(number), 1), bool)], axis=1)
        upto = np.where(last, total, 0)
        before = np.concatenate([np.zeros((len(number), 1)), np.maximum.accumulate(upto, axis=1)[:, :-1]], axis=1)
        sums = np.where(last, total - before, 0)
        return np.sqrt((sums**2).sum(axis=1))

    def table(self, words: list[str], parts: np.ndarray) -> FeatureTable:
        """For each feature its weighted sum over ``words``, each of norm 1, with a column for each column of ``parts``."""
        found = [(rows, numbers, weights / np.maximum(self.norms(numbers, weights), 1e-9)[:, None]) for rows, numbers, weights in self.features(words)]
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *[numbers[weights > 0] for _, numbers, weights in found]]))
        index = np.zeros(1 << FEATURES_LOG2, np.int32)
        index[used] = np.arange(1, len(used) + 1)
        values = np.zeros((len(used) + 1, parts.shape[1]), np.float32)
        for rows, numbers, weights in found:
            for column in range(numbers.shape[1]):
                np.add.at(values, index[numbers[:, column]], weights[:, column, None] * parts[rows])
        values[0] = 0
        letters = np.zeros(0x110000, bool)
        letters[[ord(letter) for letter in set("".join(words))]] = True
        return FeatureTable(index, values, letters)

    def project(self, words: list[str], table: FeatureTable) -> np.ndarray:
        """Inner products of the words' features, of norm 1, with the columns of a feature table."""
        out = np.zeros((len(words), table.values.shape[1]), np.float32)
        for rows, numbers, weights in self.features(words, table.letters):
            place = table.index[numbers]
            if out.shape[1] == 1:
                total = np.einsum("rc,rc->r", weights, table.values[:, 0][place])[:, None]
            else:
                total = np.zeros((len(rows), table.values.shape[1]), np.float32)
                for column in np.flatnonzero(place.any(axis=0)):
                    total += weights[:, column, None] * table.values[place[:, column]]
            hit = np.flatnonzero(total.any(axis=1))
            out[rows[hit]] = total[hit] / np.maximum(self.norms(numbers[hit], weights[hit]), 1e-9)[:, None]
        return out

    def gram(self, words: list[str], others: list[str]) -> np.ndarray:
        """Kernel values of all words with all others."""
        out = np.zeros((len(words), len(others)), np.float32)
        sizes = [1 + sum(map(str.isalpha, word)) ** 3 // 6 for word in others]
        start = 0
        while start < len(others):
            end, cells = start + 1, sizes[start]
            while end < len(others) and (cells + sizes[end]) * (end + 1 - start) <= TABLE_CELLS:
                cells += sizes[end]
                end += 1
            part = others[start:end]
            out[:, start:end] = self.project(words, self.table(part, np.eye(len(part), dtype=np.float32)))
            start = end
        return out
