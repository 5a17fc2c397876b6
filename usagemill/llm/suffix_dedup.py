"""Suffix-array dedup: bytes covered by strings of a given length that start anywhere else as well.

1. Runs of windows are found around anchors (``anchors.py``); a filter drops those whose gram occurs once.
2. Runs are counted by the digest of all their bytes: equal runs repeat as a whole. That settles the inside of long
   copies with no text moved, counted in each task before the shuffle.
3. Of anchors with more than one kind of run, each kind sends its bytes from one text to the anchor's reducer, where a
   hash-compared suffix sort (``suffix_sort.py``) tells which windows repeat, with byte-wise checks.
4. An anchor with very many kinds is not gathered in one place: its windows are counted by digest instead.
5. The spans are brought to the texts that have some.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.anchors import Runs, runs
from usagemill.llm.repeats import RepeatFilter, cells_log2, member_filter, repeat_filter
from usagemill.llm.spans import cut_out, text_key
from usagemill.llm.suffix_sort import repeated_windows
from usagemill.llm.tables import byte_chunks, kept_table, offsets

LENGTH = 400
GRAM = 64
# An anchor with more kinds of runs than this is counted window by window, over all reducers.
HOT_KINDS = 4096
SORT_BYTES = 2 << 20
# Runs that a byte of text makes, as measured with the defaults; it sets the size of the filter only.
RUNS_PER_BYTE = 0.006
# A task remembers so many kinds of runs that it has sent.
SENT_KINDS = 1 << 17
# Longer texts are looked at in pieces that overlap by a window.
PIECE_BYTES = 4 << 20

_digest = xxhash.xxh3_128_digest


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Texts, or pieces of a long one that share all but their first window starts: the text and place of each."""
    short = [(i, 0, text) for i, text in enumerate(texts) if len(text) <= PIECE_BYTES]
    if short:
        yield [text for _, _, text in short], [(i, at) for i, at, _ in short]
    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            for at in range(0, len(text) - length + 1, PIECE_BYTES):
                yield [text[at : at + PIECE_BYTES + length - 1]], [(i, at)]


def _found(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[bytes, Runs, np.ndarray, np.ndarray, list[bytes]]]:
    """Of each chunk: all bytes, runs, and for each run its start in the text less that in the chunk, and its key."""
    for _, texts in byte_chunks(batch, "text", 1 << 19):
        keys = [text_key(text) for text in texts]
        for parts, places in _pieces(texts, length):
            begins = offsets(np.fromiter(map(len, parts), np.int64, len(parts)))
            data = b"".join(parts)
            found = runs(np.frombuffer(data, np.uint8), begins, length, gram)
            shift = np.array([at for _, at in places], np.int64) - begins[:-1]
            owner = [keys[i] for i, _ in places]
            yield data, found, shift[found.text], found.text, owner


def _grams(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found, _, _, _ in _found(batch, length, gram):
                yield pa.record_batch([pa.array(found.gram.view(np.int64))], names=["gram"])

    return run


def _chosen(data: bytes, found: Runs, wanted: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """Of some runs: number, text, digest of all bytes and the anchor's place, first and last start, the anchor's
    distance from the first, bytes."""
    at = np.flatnonzero(wanted)
    part = found.pick(at)
    first, last = part.first.tolist(), part.last.tolist()
    reach = (part.anchor - part.first).tolist()
    for i, text, a, b, r in zip(at.tolist(), part.text.tolist(), first, last, reach):
        own = data[a : b + length]
        whole = xxhash.xxh3_64_intdigest(own + r.to_bytes(4, "little"))
        yield i, text, whole - (1 << 64) if whole >> 63 else whole, a, b, r, own


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=names)


def _candidates(seen: RepeatFilter, length: int, gram: int):
    """Runs whose gram may repeat, without their bytes: of each kind one for each text, with their number.

    Kinds that a text has more than once are spans already; those come merged, without a gram.
    """
    names = ["gram", "whole", "key", "first", "last", "n"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def of_text(rows: list[tuple], key: bytes, own: list[tuple]) -> None:
        times = Counter(whole for _, whole, _, _ in own)
        met, span = set(), None
        for gram_, whole, first, last in own:
            if whole not in met:
                met.add(whole)
                rows.append((gram_, whole, key, first, last, times[whole]))
            if times[whole] > 1:
                if span is not None and rows[span][4] >= first - length:
                    rows[span] = (None, None, key, rows[span][3], last, None)
                else:
                    span = len(rows)
                    rows.append((None, None, key, first, last, None))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found, shift, _, owner in _found(batch, length, gram):
                rows, current, own = [], -1, []
                for i, text, whole, first, last, _, _ in _chosen(data, found, seen.may_repeat(found.gram.view(np.int64)), length):
                    if text != current:
                        if own:
                            of_text(rows, owner[current], own)
                        current, own = text, []
                    own.append((int(found.gram[i].view(np.int64)), whole, first + int(shift[i]), last + int(shift[i])))
                if own:
                    of_text(rows, owner[current], own)
                yield _record(rows, names, kinds)

    return run


_KEY_BYTES = 7


def _mark(whole: int, key: bytes, first: int) -> int:
    """A signed number for a kind of run at a place of a text; ``_mark_column`` is the same in a plan."""
    value = (whole ^ int.from_bytes(key[:_KEY_BYTES], "big") ^ (first << 20)) & ((1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def _mark_column(whole: Column, key: Column, first: Column) -> Column:
    number = F.conv(F.hex(F.substring(key, 1, _KEY_BYTES)), 16, 10).cast("bigint")
    return whole.bitwiseXOR(number).bitwiseXOR(F.shiftleft(first, 20))


def _contexts(mixed: RepeatFilter, chosen: RepeatFilter, length: int, gram: int):
    """The bytes of one run of each kind whose gram has several kinds, that of the least mark; if its text has copies, one
    from each task that has some."""
    names = ["gram", "whole", "key", "first", "reach", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for data, found, shift, _, owner in _found(batch, length, gram):
                signed = found.gram.view(np.int64)
                several = list(_chosen(data, found, mixed.may_repeat(signed), length))
                marks = [_mark(whole, owner[text], first + int(shift[i])) for i, text, whole, first, _, _, _ in several]
                rows = []
                for (i, text, whole, first, _, reach, own), one in zip(several, chosen.may_repeat(np.array(marks, np.int64)).tolist()):
                    if one and whole not in sent:
                        if len(sent) < SENT_KINDS:
                            sent.add(whole)
                        rows.append((int(signed[i]), whole, owner[text], first + int(shift[i]), reach, own))
                yield _record(rows, names, kinds)

    return run


def _hot_windows(hot: RepeatFilter, length: int, gram: int):
    """Digest and place of each window of the runs around hot anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found, shift, text, owner in _found(batch, length, gram):
                for i in np.flatnonzero(hot.may_repeat(found.gram.view(np.int64))).tolist():
                    a, b, move = int(found.first[i]), int(found.last[i]), int(shift[i])
                    digests = [_digest(data[at : at + length]) for at in range(a, b + 1)]
                    keys = pa.array([owner[text[i]]] * len(digests), pa.binary())
                    yield pa.record_batch(
                        [pa.array(digests, pa.binary()), keys, pa.array(np.arange(a, b + 1) + move)], names=["window", "key", "start"]
                    )

    return run


def _sorted_out(length: int):
    """Windows that repeat among the contexts of a partition, which come sorted by gram and kind."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(row["bytes"] for row in rows), np.uint8)
        begins = offsets(np.array([len(row["bytes"]) for row in rows], np.int64))
        reach = np.array([row["reach"] for row in rows], np.int64)
        grams = np.array([row["gram"] for row in rows], np.int64)
        counts = np.diff(np.append(np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])), len(grams)))
        piece, at = repeated_windows(data, begins[:-1], begins[1:], begins[:-1] + reach, counts, length)
        order = np.lexsort((at, piece))
        piece, at = piece[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else piece
        ends = np.append(new[1:], len(at)) - 1 if len(at) else piece
        first = np.array([row["first"] for row in rows], np.int64)
        move = (first - begins[:-1])[piece[new]]
        keys = pa.array([rows[i]["key"] for i in piece[new].tolist()], pa.binary())
        return pa.record_batch([keys, pa.array(at[new] + move), pa.array(at[ends] + move + length)], names=["key", "start", "end"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["gram"] != group[-1]["gram"]:
                    if len(group) > 1:
                        held += group
                        size += sum(len(one["bytes"]) for one in group)
                    group = []
                    if size > SORT_BYTES:
                        yield solve(held)
                        held, size = [], 0
                if not group or row["whole"] != group[-1]["whole"]:
                    group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``key`` (a digest of the text), ``start``, ``end``: spans of bytes covered by strings that start elsewhere too."""
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into the window")
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length)
    runs_ = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * RUNS_PER_BYTE
    seen = repeat_filter(texts.mapInArrow(_grams(length, gram), "gram bigint"), cells_log2(runs_))
    shape = "gram bigint, whole bigint, key binary, first bigint, last bigint, n bigint"
    found = kept_table(texts.mapInArrow(_candidates(seen, length, gram), shape), "candidates")
    span = [F.col("first").alias("start"), (F.col("last") + length).alias("end")]
    spans = [found.filter("gram IS NULL").select("key", *span)]
    found = found.filter("gram IS NOT NULL")
    # Of each kind the run of the least mark stands for all.
    mark = F.min(_mark_column(F.col("whole"), F.col("key"), F.col("first"))).alias("mark")
    kinds = kept_table(found.groupBy("gram", "whole").agg(F.sum("n").alias("n"), mark), "kinds")
    # Adaptive execution splits a kind that very many texts share.
    spans.append(found.join(kinds.filter("n > 1").select("gram", "whole"), ["gram", "whole"]).select("key", *span))

    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = kept_table(several, "grams")
    few = several.filter(F.col("kinds") <= hot_kinds).select("gram")
    chosen = kinds.join(few, "gram").select("mark")
    shape = "gram bigint, whole bigint, key binary, first bigint, reach bigint, bytes binary"
    contexts = texts.mapInArrow(_contexts(member_filter(few), member_filter(chosen), length, gram), shape)
    contexts = contexts.repartition("gram").sortWithinPartitions("gram", "whole")
    spans.append(contexts.mapInArrow(_sorted_out(length), "key binary, start bigint, end bigint"))
    hottest = several.filter(F.col("kinds") > hot_kinds).select("gram")
    if not hottest.isEmpty():
        hot = member_filter(hottest)
        windows = texts.mapInArrow(_hot_windows(hot, length, gram), "window binary, key binary, start bigint")
        windows = kept_table(windows, "windows")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
        spans.append(windows.join(twice, "window").select("key", "start", (F.col("start") + length).alias("end")))
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    return kept_table(out.distinct(), "spans")


def _cut_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return len(text), b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, carry: list[str], length: int = LENGTH, **options) -> DataFrame:
    """``row`` (a struct of the carried columns), ``n_bytes, n_removed, n_spans, kept`` of every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that starts at another place of any text too, overlaps
    counted, is removed; strings are judged on the input. A null text is an empty one. Texts shorter than ``length``
    stay whole. Equal texts, also under one doc_id, are copies of one another and lose the same bytes. ``kept`` is
    binary, as a cut may fall inside a letter. Columns of ``docs`` may have any name; an empty table gives no row.
    """
    spans = repeated_spans(docs, length, **options)
    cut = cut_out(docs, carry, spans, lambda text, _: text_key(text), _cut_bytes)
    return cut.select("row", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    return remove_repeats(docs, ["doc_id"], **options).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
