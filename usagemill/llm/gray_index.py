"""A hierarchical index over 64-bit fingerprints in Gray order, and the links it finds.

Fingerprints are sorted by their rank in the Gray sequence, so that neighbours share many bits. Runs of FANOUT form a
node, runs of nodes the next level. A node keeps the bits on which all below it agree, less those that its parent
keeps already. A search walks down, adds up the bits in which the query differs from the kept ones, and drops a whole
group once the sum is over the limit.
"""

from __future__ import annotations

import numpy as np

from usagemill.llm.tables import spread

FANOUT = 8
FRONTIER = 1 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The index of a forest: one tree for each group; ``codes`` are sorted by group, then by Gray rank."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        starts = np.arange(len(codes))
        pattern_and, pattern_or, group = codes, codes, groups
        self.levels: list[dict[str, np.ndarray]] = []  # from the leaves' parents up to the roots
        while True:
            first = np.concatenate([[True], group[1:] != group[:-1]])
            place = np.arange(len(group))
            place = place - np.maximum.accumulate(np.where(first, place, 0))
            cuts = np.flatnonzero(place % FANOUT == 0)
            ends = np.append(cuts[1:], len(group))
            pattern_and = np.bitwise_and.reduceat(pattern_and, cuts)
            pattern_or = np.bitwise_or.reduceat(pattern_or, cuts)
            group = group[cuts]
            starts = starts[cuts]
            same = ~(pattern_and ^ pattern_or)
            self.levels.append({"first": cuts, "count": ends - cuts, "same": same, "bits": pattern_and, "row": starts})
            if not np.any(group[1:] == group[:-1]):
                break
        for below, above in zip(self.levels, self.levels[1:]):
            parent = np.repeat(above["same"], above["count"])
            below["own"] = below["same"] & ~parent
            below["rest"] = ~parent
        self.levels[-1]["own"] = self.levels[-1]["same"]
        self.root = np.repeat(np.arange(len(group)), np.diff(np.append(self.levels[-1]["row"], len(codes))))

    def near(self, rows: np.ndarray, limit: int, labels: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray):
        """Pairs of a query row and a later row of its tree that differ in ``limit`` bits at most.

        ``labels`` has the smallest and largest component of each node by level, ``own`` that of each row: a group
        that is already in the query's component as a whole holds no new link and is dropped.
        """
        stack = [(len(self.levels) - 1, rows, self.root[rows], np.zeros(len(rows), np.uint8))]
        while stack:
            depth, query, node, differ = stack.pop()
            level = self.levels[depth]
            low, high = labels[depth]
            differ = differ + np.bitwise_count((self.codes[query] ^ level["bits"][node]) & level["own"][node])
            keep = (differ <= limit) & ~((low[node] == own[query]) & (high[node] == own[query]))
            query, node, differ = query[keep], node[keep], differ[keep]
            for start in range(0, len(query), FRONTIER // FANOUT):
                part = slice(start, start + FRONTIER // FANOUT)
                counts = level["count"][node[part]]
                child = spread(level["first"][node[part]], counts)
                asked = np.repeat(query[part], counts)
                if depth:
                    stack.append((depth - 1, asked, child, np.repeat(differ[part], counts)))
                else:
                    later = child > asked
                    asked, child = asked[later], child[later]
                    found = np.bitwise_count(self.codes[asked] ^ self.codes[child]) <= limit
                    yield asked[found], child[found]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the smallest row of each) after the links ``a - b`` are added."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            onward = labels[labels]
            if np.array_equal(onward, labels):
                break
            labels = onward
    return labels


def group_links(codes: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row of its component, over links of at most ``limit`` bits inside a group.

    ``codes`` are distinct within a group and sorted by group, then by Gray rank. Queries come in blocks that grow, so
    that a dense group is soon known as one component and is then passed over.
    """
    labels = np.arange(len(codes))
    if not len(codes):
        return labels
    index = GrayIndex(codes, groups)
    start, block = 0, 256
    while start < len(codes):
        rows = np.arange(start, min(start + block, len(codes)))
        nodes = [(np.minimum.reduceat(labels, level["row"]), np.maximum.reduceat(labels, level["row"])) for level in index.levels]
        for a, b in index.near(rows, limit, nodes, labels):
            labels = join_labels(labels, a, b)
        start += block
        block = min(block * 2, 1 << 15)
    return labels
