"""Suffix sorting by hash comparison, and the windows that repeat among pieces of text around a common anchor.

Two suffixes are compared by their longest common extension, a binary search over prefix hashes; a merge sort thus
takes a number of hash look-ups for each comparison that is logarithmic in the length. The extensions between
neighbours in the final order are checked against the bytes, and a collision leads to another base.
"""

from __future__ import annotations

import numpy as np

from usagemill.llm.anchors import BASES, PrefixHash, grouped_offsets
from usagemill.llm.tables import offsets, spread


class Collision(Exception):
    """Equal hashes of unequal bytes."""


class SuffixSorter:
    """Orders of stretches ``[start, start + size)`` of ``data`` within groups."""

    def __init__(self, data: np.ndarray, base: int):
        self.data = data
        self.hashes = PrefixHash(data, base)

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning from places ``a`` and ``b``, at most ``limit``."""
        low, high = np.zeros(len(a), np.int64), limit.astype(np.int64)
        while True:
            middle = (low + high + 1) >> 1
            open_ = low < high
            if not open_.any():
                return low
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, a, size_a, b, size_b, or_equal: np.ndarray) -> np.ndarray:
        """Whether each stretch at ``a`` comes before that at ``b``; equal ones as ``or_equal`` says."""
        limit = np.minimum(size_a, size_b)
        shared = self.extension(a, b, limit)
        inside = shared < limit
        last = len(self.data) - 1
        letter_a = np.where(inside, self.data[np.minimum(a + shared, last)], 0)
        letter_b = np.where(inside, self.data[np.minimum(b + shared, last)], 0)
        return np.where(inside, letter_a < letter_b, np.where(size_a == size_b, or_equal, size_a < size_b))

    def sort(self, start: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members in order within their groups (of ``counts`` consecutive members each), by bottom-up merging, and
        the common beginning of each with the one before it (0 for the first of a group)."""
        group, place = grouped_offsets(counts)
        begin, many = offsets(counts)[:-1][group], counts[group]
        order = np.arange(len(start))
        width = 1
        while width < counts.max(initial=0):
            base = place // (2 * width) * (2 * width)
            right = place - base >= width
            low = np.where(right, base, base + width)
            high = np.minimum(np.where(right, base + width, base + 2 * width), many)
            live = np.flatnonzero(low < high)
            first = low.copy()
            bottom, top = low[live], high[live]
            own = order[live]
            while True:
                open_ = np.flatnonzero(bottom < top)
                if not len(open_):
                    break
                middle = (bottom[open_] + top[open_]) >> 1
                other = order[begin[live[open_]] + middle]
                mine = own[open_]
                before = self.less(start[other], size[other], start[mine], size[mine], right[live[open_]])
                bottom[open_] = np.where(before, middle + 1, bottom[open_])
                top[open_] = np.where(before, top[open_], middle)
            target = place.copy()
            rank = bottom - first[live]
            target[live] = base[live] + np.where(right[live], place[live] - base[live] - width, place[live] - base[live]) + rank
            merged = np.empty_like(order)
            merged[begin + target] = order
            order = merged
            width *= 2
        shared = np.zeros(len(order), np.int64)
        later = np.flatnonzero(place > 0)
        a, b = order[later], order[later - 1]
        shared[later] = self.extension(start[a], start[b], np.minimum(size[a], size[b]))
        self.check(start[a], start[b], shared[later], np.minimum(size[a], size[b]))
        return order, shared

    def check(self, a: np.ndarray, b: np.ndarray, shared: np.ndarray, limit: np.ndarray) -> None:
        """Compares the bytes of each common beginning, in slices, and the byte after it."""
        cuts = np.searchsorted(offsets(shared), np.arange(0, int(shared.sum()) + 1, 1 << 20))
        cuts = np.unique(np.concatenate([[0], cuts, [len(a)]]).clip(0, len(a)))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = slice(first, last)
            if not np.array_equal(self.data[spread(a[part], shared[part])], self.data[spread(b[part], shared[part])]):
                raise Collision
        inside = shared < limit
        if (self.data[(a + shared)[inside]] == self.data[(b + shared)[inside]]).any():
            raise Collision


def _classes(order: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """A number for each member, equal for those with no break between them in the order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(breaks)
    return out


def repeated_windows(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray, counts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and window starts (places in ``data``) of all windows that another piece of the group has as well.

    Piece i is ``data[start:end]`` with its anchor at ``anchor``; groups of ``counts`` consecutive pieces share their
    anchor's gram. Windows are equal if they start as far from the anchor, agree to its right and to its left: pieces
    are sorted by the suffix from the anchor on, and by the reversed text before it.
    """
    for base in BASES:
        try:
            right = SuffixSorter(data, base).sort(anchor, end - anchor, counts)
            left = SuffixSorter(data[::-1], base).sort(len(data) - anchor, anchor - start, counts)
            break
        except Collision:
            continue
    else:
        raise RuntimeError("hashes of three bases collide")
    group, place = grouped_offsets(counts)
    right_shared, left_shared = np.where(place == 0, -1, right[1]), np.where(place == 0, -1, left[1])
    pieces, windows = [], []
    lowest, highest = start - anchor, end - anchor - length
    for offset in range(int(lowest.min(initial=0)), int(highest.max(initial=-1)) + 1):
        inside = np.flatnonzero((lowest <= offset) & (offset <= highest))
        if len(inside) < 2:
            continue
        after = _classes(right[0], right_shared < offset + length)[inside]
        before = _classes(left[0], left_shared < -offset)[inside]
        both = after * len(start) + before
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        if same.any():
            repeat = np.zeros(len(order), bool)
            repeat[order[1:]] |= same
            repeat[order[:-1]] |= same
            pieces.append(inside[repeat])
            windows.append(anchor[inside[repeat]] + offset)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(windows)
