"""What the operators on repeated passages share: texts by digest, filters of members, and cutting spans out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.llm.anchors import merged_spans
from usagemill.llm.repeats import RepeatFilter, member_filter
from usagemill.llm.tables import byte_chunks


def text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


Key = Callable[[bytes, object], bytes]
Cutter = Callable[[bytes, np.ndarray, np.ndarray], tuple[int, bytes]]


def _parts(batch: pa.RecordBatch, key: Key, members: RepeatFilter) -> Iterator[tuple[range, list[bytes], list[bytes], np.ndarray]]:
    """Places, texts and keys of the rows of each piece of a batch, and whether a key may have spans."""
    ids = batch.column("id")
    for first, texts in byte_chunks(batch, "text"):
        keys = [key(text, own) for text, own in zip(texts, ids.slice(first, len(texts)).to_pylist())]
        short = np.array([int.from_bytes(one[:8], "big", signed=True) for one in keys], np.int64)
        yield range(first, first + len(texts)), texts, keys, members.may_repeat(short)


def _result(rows: pa.Array, found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["row", "n_units", "n_removed", "n_spans", "kept"]
    return pa.record_batch([rows, *[pa.array(column, kind) for column, kind in zip(columns, kinds)]], names=names)


def cut_out(docs: DataFrame, carry: list[str], spans: DataFrame, key: Key, cut: Cutter) -> DataFrame:
    """``row, n_units, n_removed, n_spans, kept`` (bytes) of every row, with the spans of its key taken out.

    ``spans`` has ``key`` (binary), ``start`` and ``end``; ``key`` makes the key of a text and a doc_id. A filter of
    the keys with spans lets all other texts pass where they are; only those with spans are shuffled, to meet their
    spans. Adaptive execution splits the rows of a key that very many texts have.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row")
    own = docs.select(row, F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = own.schema["row"].dataType.simpleString()
    shape = f"row {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept binary"
    first_long = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint")
    members = member_filter(spans.select("key").distinct().select(first_long.alias("k")))

    def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for places, texts, _, maybe in _parts(batch, key, members):
                rest = np.flatnonzero(~maybe).tolist()
                whole = [cut(texts[i], none, none) for i in rest]
                rows = batch.column("row").take(pa.array([places[i] for i in rest], pa.int64()))
                yield _result(rows, [(units, 0, 0, kept) for units, kept in whole])

    def touched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, texts, keys, maybe in _parts(batch, key, members):
                chosen = np.flatnonzero(maybe).tolist()
                rows = batch.column("row").take(pa.array([places[i] for i in chosen], pa.int64()))
                columns = [pa.array([keys[i] for i in chosen], pa.binary()), rows, pa.array([texts[i] for i in chosen], pa.binary())]
                yield pa.record_batch(columns, names=["key", "row", "text"])

    def cutting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            for first, texts in byte_chunks(batch, "text"):
                found = []
                for i, text in enumerate(texts, first):
                    own_spans = lists[i].values
                    starts = ends = np.zeros(0, np.int64)
                    if own_spans is not None:
                        starts = own_spans.field("start").to_numpy(zero_copy_only=False)
                        starts, ends = merged_spans(starts, own_spans.field("end").to_numpy(zero_copy_only=False))
                    units, kept = cut(text, starts, ends)
                    found.append((units, int((ends - starts).sum()), len(starts), kept))
                yield _result(batch.column("row").slice(first, len(texts)), found)

    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    moved = own.mapInArrow(touched, f"key binary, row {kind}, text binary").join(by_key, "key", "left")
    return own.mapInArrow(untouched, shape).unionByName(moved.select("row", "text", "spans").mapInArrow(cutting, shape))
