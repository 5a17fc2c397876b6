"""A Bloom filter of the keys that may occur twice, built in one pass over all of them.

Each key sets two cells of a table of saturating counts 0, 1, 2. Tasks send the cells they have set, in segments of
65,536 cells with two bytes a cell; segments are merged on their own, one after the other in sorted order. A key may
be repeated if both its cells are 2; a key that does occur twice always passes. The table has at least eight cells for
each key, so that under one in twenty unrepeated keys passes, up to 2^30 cells, which bounds the broadcast (one bit a
cell: 128 MB). With more than 2^27 keys more of them pass, a third with four times as many; this costs time for the rows
that follow, and no result, as all that pass are compared by their full hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LOG2, MOST_LOG2 = 20, 30
CELLS_PER_KEY = 8
SEGMENT_LOG2 = 16
FLUSH = 1 << 18

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SCHEMA = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_BITS = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])


def cells_log2(keys: float) -> int:
    """Cells for about so many keys, as a power of two."""
    return min(MOST_LOG2, max(LEAST_LOG2, int(max(1, CELLS_PER_KEY * keys) - 1).bit_length()))


def _cells(keys: np.ndarray, log2: int) -> list[np.ndarray]:
    keys = keys.astype(np.int64, copy=False).view(np.uint64)
    keys = keys ^ (keys >> np.uint64(31))
    return [(keys * odd) >> np.uint64(64 - log2) for odd in _ODD]


def _partial(keys: np.ndarray, log2: int) -> pa.RecordBatch:
    cells, counts = np.unique(np.concatenate(_cells(keys, log2)), return_counts=True)
    segments = (cells >> np.uint64(SEGMENT_LOG2)).astype(np.int32)
    low = (cells & np.uint64((1 << SEGMENT_LOG2) - 1)).astype(np.uint16)
    cuts = np.flatnonzero(np.diff(segments)) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    once = [part.tobytes() for part in np.split(low, cuts)]
    twice = [a[b > 1].tobytes() for a, b in zip(np.split(low, cuts), np.split(counts, cuts))]
    return pa.record_batch([pa.array(segments[starts]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], schema=_SCHEMA)


def _partials(log2: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            held.append(keys)
            size += len(keys)
            if size >= FLUSH:
                yield _partial(np.concatenate(held), log2)
                held, size = [], 0
        if size:
            yield _partial(np.concatenate(held), log2)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums each segment; rows come sorted by segment, so one segment is held at a time."""
    current, counts = None, np.zeros(1 << SEGMENT_LOG2, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([current], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], schema=_BITS)

    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != current:
                if current is not None:
                    yield done()
                current = row["segment"]
                counts[:] = 0
            for part in (row["once"], row["twice"]):
                cells = np.frombuffer(part, np.uint16)
                counts[cells] = np.minimum(counts[cells] + 1, 2)
    if current is not None:
        yield done()


class RepeatFilter:
    """Tells keys that occur once for sure from those that may occur more than once."""

    def __init__(self, broadcast, log2: int):
        self.broadcast = broadcast
        self.log2 = log2

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        bits = self.broadcast.value
        out = np.ones(len(keys), bool)
        for cells in _cells(keys, self.log2):
            out &= (bits[cells >> np.uint64(3)] >> (7 - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return out

    def column(self, key: Column) -> Column:
        """A boolean for each key of a column of non-null longs."""
        own = self

        @F.arrow_udf("boolean")
        def may_repeat(keys: pa.Array) -> pa.Array:
            return pa.array(own.may_repeat(keys.to_numpy(zero_copy_only=False)))

        return may_repeat(key)


def repeat_filter(keys: DataFrame, log2: int) -> RepeatFilter:
    """The filter of the only column of ``keys``, longs, with 2^``log2`` cells; a null is no key. Runs a job."""
    partial = keys.mapInArrow(_partials(log2), "segment int, once binary, twice binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, bits binary")
    table = np.zeros((1 << log2) // 8, np.uint8)
    width = (1 << SEGMENT_LOG2) // 8
    found = merged.toArrow()  # a bit for each cell, at most: bounded by the number of cells
    for segment, bits in zip(found.column("segment").to_pylist(), found.column("bits").to_pylist()):
        table[segment * width : (segment + 1) * width] = np.frombuffer(bits, np.uint8)
    return RepeatFilter(keys.sparkSession.sparkContext.broadcast(table), log2)


def member_filter(members: DataFrame) -> RepeatFilter:
    """A filter that passes all of the only column of ``members`` (longs) and few others: each counts twice.

    The column is counted first; it should come from a written table.
    """
    return repeat_filter(members.unionAll(members), cells_log2(members.count()))
