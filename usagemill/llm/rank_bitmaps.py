"""Positions of ids in their group by bitmaps that count, instead of a sort of all rows.

An id is cut into a high part and its lowest 12 bits. Tasks send the low parts that they saw of each group and high
part as a container: a bitmap of 4,096 bits, or a list while that is shorter, with the counts of ids seen more than
once. Containers are merged one at a time. A merged container knows how many rows of its group come before it (sums
over directories of at most 2^18 entries each) and how many bits are set before each of its words, so the
position of an id is one sum and one popcount.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.llm.tables import checkpointed

LOW_BITS = 12
DIRECTORY_BITS = 17  # of a high part, twice; what is left of 64 bits makes the first directory
WIDTH = 1 << LOW_BITS
# A list of two bytes an id is longer than the bitmap from this number of ids on.
LIST_IDS = WIDTH // 16
_PARTIAL = pa.schema([("grp", pa.string()), ("high", pa.int64()), ("bits", pa.binary()), ("more", pa.binary())])
_MORE = np.dtype([("low", np.uint16), ("n", np.int64)])


def packed(lows: np.ndarray) -> bytes:
    """A container of distinct sorted low parts: a list, or the whole bitmap."""
    if len(lows) < LIST_IDS:
        return lows.astype(np.uint16).tobytes()
    bits = np.zeros(WIDTH, np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(body: bytes) -> np.ndarray:
    """The low parts of a container."""
    if len(body) < WIDTH // 8:
        return np.frombuffer(body, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")).astype(np.uint16)


def _more(lows: np.ndarray, counts: np.ndarray) -> bytes:
    """Low parts that occur more than once, with the number of further rows of each."""
    out = np.zeros(int((counts > 1).sum()), _MORE)
    out["low"], out["n"] = lows[counts > 1], counts[counts > 1] - 1
    return out.tobytes()


def _partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(0).dictionary_encode()
        code = groups.indices.to_numpy(zero_copy_only=False)
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(ids)))
        code, high, low = code[at], ids[at] >> LOW_BITS, (ids[at] & (WIDTH - 1)).astype(np.uint16)
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (high[1:] != high[:-1])) + 1
        first = np.concatenate([[0], cuts])
        lows, many = np.split(low, cuts), np.split(counts, cuts)
        yield pa.record_batch(
            [
                groups.dictionary.take(pa.array(code[first])),
                pa.array(high[first]),
                pa.array([packed(one) for one in lows], pa.binary()),
                pa.array([_more(one, n) for one, n in zip(lows, many)], pa.binary()),
            ],
            schema=_PARTIAL,
        )


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One container for each group and high part; partial ones come sorted by these."""
    key, parts = None, []

    def done() -> pa.RecordBatch:
        counts = np.zeros(WIDTH, np.int64)
        for bits, more in parts:
            counts[unpacked(bits)] += 1
            further = np.frombuffer(more, _MORE)
            counts[further["low"]] += further["n"]
        lows = np.flatnonzero(counts).astype(np.uint16)
        columns = [[key[0]], [key[1]], [packed(lows)], [_more(lows, counts[lows])], [int(counts.sum())]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*_PARTIAL.types, pa.int64()])], names=[*_PARTIAL.names, "n"])

    def folded() -> tuple[bytes, bytes]:
        """What has been gathered, as one part, so that no more than a few parts are held."""
        row = done().to_pylist()[0]
        return row["bits"], row["more"]

    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["high"]) != key:
                if parts:
                    yield done()
                key, parts = (row["grp"], row["high"]), []
            parts.append((row["bits"], row["more"]))
            if len(parts) > 1024:
                parts = [folded()]
    if parts:
        yield done()


class Container:
    """Answers how many rows of a container come before an id, and how many rows have that id."""

    def __init__(self, bits: bytes, more: bytes):
        self.list = np.frombuffer(bits, np.uint16) if len(bits) < WIDTH // 8 else None
        if self.list is None:
            self.words = np.frombuffer(bits, np.uint64)
            self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        further = np.frombuffer(more, _MORE)
        self.repeated = further["low"]
        self.further = np.concatenate([[0], np.cumsum(further["n"])])

    def rank(self, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.list is not None:
            before = np.searchsorted(self.list, lows)
        else:
            word, bit = lows >> 6, (lows & 63).astype(np.uint64)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            before = self.directory[word] + np.bitwise_count(below)
        left, right = np.searchsorted(self.repeated, lows), np.searchsorted(self.repeated, lows, "right")
        return before + self.further[left], 1 + self.further[right] - self.further[left]


def _ranked(payload: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, base, number, size = None, 0, 0, 0
        for batch in batches:
            bits = batch.column("bits")
            is_row = np.asarray(bits.is_null())
            lows = batch.column("low").fill_null(0).to_numpy(zero_copy_only=False)
            out = np.zeros((4, batch.num_rows), np.int64)
            heads = np.flatnonzero(~is_row)
            for begin, end in zip([0, *(heads + 1).tolist()], [*heads.tolist(), batch.num_rows]):
                if begin:
                    head = {name: batch.column(name)[begin - 1].as_py() for name in ("bits", "more", "base", "number", "size")}
                    container, base, number, size = Container(head["bits"], head["more"]), head["base"], head["number"], head["size"]
                if end > begin:
                    before, same = container.rank(lows[begin:end])
                    for k, value in enumerate((number, base + before, same, size)):
                        out[k, begin:end] = value
            columns = [pa.array(one[is_row]) for one in out]
            kept = batch.select(payload).filter(pa.array(is_row))
            yield pa.record_batch([*columns, *kept.columns], names=["number", "rank", "same", "size", *payload])

    return run


def _before(n: str, own: str, *within: str) -> Column:
    """The sum of ``n`` over the rows with a smaller ``own``, among those that agree ``within``."""
    earlier = Window.partitionBy(*within).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0))


def containers(rows: DataFrame) -> DataFrame:
    """``grp, high, bits, more, n, base`` of the columns ``grp`` (a non-null string) and ``id`` (a non-null long).

    ``base`` is the number of rows of the group with a smaller high part. It is summed over three directories of 17 or 18
    bits each, so no window holds more than 2^18 rows, however the ids are spread.
    """
    partial = rows.select("grp", "id").mapInArrow(_partials, "grp string, high bigint, bits binary, more binary")
    dealt = partial.repartition("grp", "high").sortWithinPartitions("grp", "high")
    merged = checkpointed(dealt.mapInArrow(_merged, "grp string, high bigint, bits binary, more binary, n bigint"))
    own = merged.select("grp", "high", "n", F.shiftright("high", DIRECTORY_BITS).alias("mid"), F.shiftright("high", 2 * DIRECTORY_BITS).alias("top"))
    mids = own.groupBy("grp", "mid", "top").agg(F.sum("n").alias("n"))
    tops = mids.groupBy("grp", "top").agg(F.sum("n").alias("n"))
    tops = tops.select("grp", "top", _before("n", "top", "grp").alias("of_top"))
    mids = mids.withColumn("of_mid", _before("n", "mid", "grp", "top")).drop("n").join(tops, ["grp", "top"])
    own = own.withColumn("of_high", _before("n", "high", "grp", "mid")).drop("n", "top").join(mids, ["grp", "mid"])
    base = own.select("grp", "high", (F.col("of_top") + F.col("of_mid") + F.col("of_high")).alias("base"))
    return merged.join(base, ["grp", "high"])


def ranked(rows: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (``grp, id`` and more) with ``number, size`` of their group, ``rank`` and ``same``.

    ``rank`` counts the rows of the group with a smaller id, ``same`` those with this id, itself included. ``found`` is
    what ``containers`` gives for the same rows, ``groups`` has ``grp, number, size``. Rows meet their container by
    group and high part: a group of any size is dealt over its containers.
    """
    payload = [name for name in rows.columns if name != "grp"]
    heads = found.join(groups, "grp").select("grp", "high", F.lit(None).cast("int").alias("low"), "bits", "more", "base", "number", "size")
    for name, kind in rows.select(*payload).dtypes:
        heads = heads.withColumn(name, F.lit(None).cast(kind))
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in heads.select("bits", "more", "base", "number", "size").dtypes]
    low = F.col("id").bitwiseAND(F.lit(WIDTH - 1)).cast("int").alias("low")
    each = rows.select("grp", F.shiftright("id", LOW_BITS).alias("high"), low, *empty, *payload)
    dealt = heads.unionByName(each).repartition("grp", "high").sortWithinPartitions("grp", "high", F.col("bits").isNull())
    shape = ", ".join(f"{name} {kind}" for name, kind in rows.select(*payload).dtypes)
    return dealt.mapInArrow(_ranked(payload), f"number bigint, rank bigint, same bigint, size bigint, {shape}")
