"""Anchors that equal windows share, wherever they stand.

A window of ``length`` units holds ``length - gram + 1`` grams; the one with the smallest hash, the first of equals, is
its anchor. The choice looks at nothing outside the window, so equal windows have equal anchors at the same place.
Consecutive windows with one anchor form a run. A window can only repeat if its anchor's gram does, so runs with a
gram that occurs once are out after a look at their hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from usagemill.llm.tables import offsets, spread

# Fixed odd multipliers of the polynomial hashes; the later ones are for a second try after a collision.
BASES = (0x9E3779B97F4A7C55, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
_LOW = np.uint64(0xFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < size:
        room = max(size, 1 << 16)
        held = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(room, factor, np.uint64)
            steps[0] = 1
            held.append(np.multiply.accumulate(steps))
        _powers[base] = held = tuple(held)
    return held[0][:size], held[1][:size]


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class PrefixHash:
    """Polynomial hashes of all stretches of an array of units, out of those of its prefixes."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _power(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


@dataclass
class Runs:
    """Windows ``first`` to ``last`` (their starts) of text ``text`` share the anchor at ``anchor``, a gram of hash ``gram``."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray

    def pick(self, chosen: np.ndarray) -> Runs:
        return Runs(self.text[chosen], self.first[chosen], self.last[chosen], self.anchor[chosen], self.gram[chosen])


def runs(values: np.ndarray, begins: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of all windows that lie within one text; ``begins`` has the texts' starts, and the end of the last."""
    windows = np.maximum(0, np.diff(begins) - length + 1)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.view(np.uint64))
    hashes = PrefixHash(values)
    at = np.arange(len(values) - gram + 1)
    grams = mixed(hashes.of(at, at + gram))
    lowest = (grams & ~_LOW) | at.astype(np.uint64)
    span, size = length - gram + 1, 1
    while size * 2 <= span:
        lowest = np.minimum(lowest[:-size], lowest[size:])
        size *= 2
    if span > size:
        lowest = np.minimum(lowest[: len(lowest) - (span - size)], lowest[span - size :])
    starts = spread(begins[:-1], windows)
    anchor = (lowest[starts] & _LOW).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    ends = np.append(cuts[1:], len(starts)) - 1
    text = np.searchsorted(begins, starts[cuts], "right") - 1
    return Runs(text, starts[cuts], starts[ends], anchor[cuts], grams[anchor[cuts]])


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans apart from one another, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def grouped_offsets(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive groups: the group of each member, and its place in the group."""
    begins = offsets(counts)
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(begins[-1]) - begins[:-1][group]
