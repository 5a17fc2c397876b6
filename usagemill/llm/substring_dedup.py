"""Substring dedup: words covered by a window of words that starts earlier as well.

The reference of each document is all that comes before it, so the reference is as large as the corpus. It is cut
into shards by the anchors of its windows (``anchors.py``): windows that are equal have the same anchor and so fall
into the same shard. A shard holds only what may repeat: one copy, the earliest, of each kind of run around an anchor
that has several kinds. A suffix automaton is built over the shard in the order of the documents, the shard's runs
are streamed through it for matching statistics, and a window is removed if its string first ended before it does.
Runs that are equal as a whole are settled before, by counting digests; anchors with very many kinds are counted
window by window over all reducers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.anchors import PrefixHash, Runs, mixed, runs
from usagemill.llm.automaton import SuffixAutomaton
from usagemill.llm.repeats import RepeatFilter, cells_log2, member_filter, repeat_filter
from usagemill.llm.spans import cut_out
from usagemill.llm.tables import byte_chunks, kept_table, offsets

LENGTH = 20
GRAM = 4
HOT_KINDS = 4096
SHARD_WORDS = 1 << 17
SENT_KINDS = 1 << 16
PIECE_WORDS = 1 << 19
# Runs that a byte of text makes, as measured with the defaults; it sets the size of the filter only.
RUNS_PER_BYTE = 0.016

# Space, and tab to carriage return.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_digest = xxhash.xxh3_128_digest


def _short(data: bytes) -> int:
    """A signed 64-bit digest."""
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


class _Chunk:
    """The words of some texts, and the runs of their windows."""

    def __init__(self, texts: list[bytes], ids: list, length: int, gram: int):
        self.ids, self.keys = ids, [_short(text) for text in texts]
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        letter = ~_SPACE[data]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # of the space after a word, one byte stays
        edges = np.concatenate([[0], np.cumsum(kept)])
        text_ends = edges[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
        norm, letter = data[kept], letter[kept]
        norm = np.where(letter, norm, np.uint8(0x20))
        self.joined = norm.tobytes()
        self.ends = np.flatnonzero(~letter)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.begins = np.concatenate([[0], np.searchsorted(self.starts, text_ends)])
        values = PrefixHash(norm).of(self.starts, self.ends)
        parts = list(_runs(mixed(values), self.begins, length, gram))
        self.runs = Runs(*[np.concatenate([getattr(part, name) for part in parts]) for name in ("text", "first", "last", "anchor", "gram")])
        self.length = length

    def passage(self, first: int, last: int) -> bytes:
        """The words of the windows that start at ``first`` to ``last``."""
        return self.joined[self.starts[first] : self.ends[last + self.length - 1]]

    def chosen(self, wanted: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """Of some runs: text, gram, digest of all words and the anchor's place, first and last start, words."""
        at = np.flatnonzero(wanted)
        found = self.runs.pick(at)
        begin = self.begins[found.text]
        edges = zip(self.starts[found.first].tolist(), self.ends[found.last + self.length - 1].tolist())
        reach = (found.anchor - found.first).tolist()
        words = [self.joined[a:b] for a, b in edges]
        whole = [_short(passage + b" %d" % r) for passage, r in zip(words, reach)]
        return zip(
            found.text.tolist(),
            found.gram.view(np.int64).tolist(),
            whole,
            (found.first - begin).tolist(),
            (found.last - begin).tolist(),
            words,
        )


def _runs(values: np.ndarray, begins: np.ndarray, length: int, gram: int) -> Iterator[Runs]:
    """Runs of all texts; a very long text is looked at in pieces that overlap by a window."""
    if len(values) <= 4 * PIECE_WORDS:
        yield runs(values, begins, length, gram)
        return
    for text, (begin, end) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        for at in range(begin, max(begin + 1, end - length + 1), PIECE_WORDS):
            part = values[at : min(end, at + PIECE_WORDS + length - 1)]
            found = runs(part, np.array([0, len(part)]), length, gram)
            yield Runs(found.text + text, found.first + at, found.last + at, found.anchor + at, found.gram)


def _chunks(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[_Chunk]:
    ids = batch.column("id")
    for first, texts in byte_chunks(batch, "text", 1 << 19):
        yield _Chunk(texts, ids.slice(first, len(texts)).to_pylist(), length, gram)


def _grams(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, length, gram):
                yield pa.record_batch([pa.array(chunk.runs.gram.view(np.int64))], names=["gram"])

    return run


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=names)


def _candidates(seen: RepeatFilter, length: int, gram: int):
    """Runs whose gram may repeat, without their words: of each kind the first in its text.

    The others of the text start later, so they are spans already; they come merged, without a gram.
    """
    names = ["gram", "whole", "id", "key", "first", "last"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [pa.int64(), pa.int64(), batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64()]
            for chunk in _chunks(batch, length, gram):
                rows, current, met, span = [], -1, set(), None
                for text, gram_, whole, first, last, _ in chunk.chosen(seen.may_repeat(chunk.runs.gram.view(np.int64))):
                    if text != current:
                        current, met, span = text, set(), None
                    if whole not in met:
                        met.add(whole)
                        rows.append((gram_, whole, chunk.ids[text], chunk.keys[text], first, last))
                    elif span is not None and rows[span][5] >= first - length:
                        rows[span] = (*rows[span][:5], last)
                    else:
                        span = len(rows)
                        rows.append((None, None, chunk.ids[text], chunk.keys[text], first, last))
                yield _record(rows, names, kinds)

    return run


def _mark(whole: int, doc_id) -> int:
    """A signed number for a kind of run in a document; ``_mark_column`` is the same in a plan."""
    number = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) + 1
    value = (whole ^ (number << 24)) & ((1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def _mark_column(whole: Column, doc_id: Column) -> Column:
    number = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) + 1, F.lit(0))
    return whole.bitwiseXOR(F.shiftleft(number, 24))


def _contexts(mixed_: RepeatFilter, wanted_: RepeatFilter, length: int, gram: int):
    """The words of the runs that stand first of their kind: one row of each kind, but for rows that repeat in other tasks."""
    names = ["gram", "whole", "id", "key", "first", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each kind the smallest document that this task has sent; a task that forgets some sends more, no less.
        sent: dict[int, tuple] = {}
        for batch in batches:
            kinds = [pa.int64(), pa.int64(), batch.schema.field("id").type, pa.int64(), pa.int64(), pa.binary()]
            for chunk in _chunks(batch, length, gram):
                found = list(chunk.chosen(mixed_.may_repeat(chunk.runs.gram.view(np.int64))))
                marks = np.array([_mark(whole, chunk.ids[text]) for text, _, whole, _, _, _ in found], np.int64)
                rows = []
                for (text, gram_, whole, first, _, words), first_of_kind in zip(found, wanted_.may_repeat(marks).tolist()):
                    if not first_of_kind:
                        continue
                    order = (chunk.ids[text] is not None, chunk.ids[text])
                    if whole in sent and sent[whole] <= order:
                        continue
                    if whole in sent or len(sent) < SENT_KINDS:
                        sent[whole] = order
                    rows.append((gram_, whole, chunk.ids[text], chunk.keys[text], first, words))
                yield _record(rows, names, kinds)

    return run


def _hot_windows(hot: RepeatFilter, length: int, gram: int):
    """Digest and place of each window of the runs around hot anchors: of each string the first in its text.

    The others are spans already and come without a digest.
    """
    names = ["window", "id", "key", "start"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [pa.binary(), batch.schema.field("id").type, pa.int64(), pa.int64()]
            for chunk in _chunks(batch, length, gram):
                rows, current, met = [], -1, set()
                chosen = np.flatnonzero(hot.may_repeat(chunk.runs.gram.view(np.int64)))
                for i in chosen.tolist():
                    text, begin = int(chunk.runs.text[i]), int(chunk.begins[chunk.runs.text[i]])
                    if text != current:
                        current, met = text, set()
                    for at in range(int(chunk.runs.first[i]), int(chunk.runs.last[i]) + 1):
                        window = _digest(chunk.passage(at, at))
                        rows.append((None if window in met else window, chunk.ids[text], chunk.keys[text], at - begin))
                        met.add(window)
                yield _record(rows, names, kinds)

    return run


def _streamed(length: int):
    """Windows with an earlier start among the runs of a partition, which come sorted by gram and kind."""

    def solve(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda row: (row["id"] is not None, row["id"], row["first"]))
        numbers: dict[bytes, int] = {}
        sequences = [[numbers.setdefault(word, len(numbers)) for word in row["words"].split()] for row in rows]
        automaton = SuffixAutomaton()
        for sequence in sequences:
            automaton.add(sequence)
        out = []
        places = offsets(np.array([len(sequence) for sequence in sequences], np.int64))
        for i, (row, sequence) in enumerate(zip(rows, sequences)):
            own, before = int(places[i]), None
            for at, (size, first) in enumerate(automaton.matches(sequence, length)):
                if size == length and first < own + at:
                    earlier = rows[int(np.searchsorted(places, first, "right")) - 1]
                    if earlier["id"] == row["id"] and earlier["key"] != row["key"]:
                        continue  # rows that repeat a doc_id
                    start = row["first"] + at + 1 - length
                    if before == start - 1:
                        out[-1] = (*out[-1][:3], start + length)
                    else:
                        out.append((row["id"], row["key"], start, start + length))
                    before = start
        return _record(out, ["id", "key", "start", "end"], [kind, pa.int64(), pa.int64(), pa.int64()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size, kind = [], [], 0, pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            for row in batch.to_pylist():
                if group and row["gram"] != group[-1]["gram"]:
                    if len(group) > 1:
                        held += group
                        size += len(group) * (length + 8)
                    group = []
                    if size > SHARD_WORDS:
                        yield solve(held, batch.schema.field("id").type)
                        held, size = [], 0
                if not group or row["whole"] != group[-1]["whole"]:
                    group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield solve(held, kind)

    return run


def earlier_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``id``, ``key`` (a digest of the text), ``start``, ``end``: spans of words covered by windows that start earlier."""
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into the window")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()
    runs_ = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * RUNS_PER_BYTE
    seen = repeat_filter(texts.mapInArrow(_grams(length, gram), "gram bigint"), cells_log2(runs_))
    shape = f"gram bigint, whole bigint, id {kind}, key bigint, first bigint, last bigint"
    found = kept_table(texts.mapInArrow(_candidates(seen, length, gram), shape), "candidates")
    span = [F.col("first").alias("start"), (F.col("last") + length).alias("end")]
    spans = [found.filter("gram IS NULL").select("id", "key", *span)]
    found = found.filter("gram IS NOT NULL")
    # A row for each text and kind: the smallest doc_id keeps the run, the others lose it as a whole.
    # A null doc_id comes before all others.
    least = [F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("unnamed")]
    kinds = kept_table(found.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), *least), "kinds")
    again = kinds.filter("n > 1").select("gram", "whole", "least", "unnamed")
    later = F.col("id").isNotNull() & (F.col("unnamed") | (F.col("id") > F.col("least")))
    # Adaptive execution splits a kind that very many documents share.
    spans.append(found.join(again, ["gram", "whole"]).filter(later).select("id", "key", *span))

    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = kept_table(several, "grams")
    few = several.filter(F.col("kinds") <= hot_kinds).select("gram")
    first = F.when(~F.col("unnamed"), F.col("least"))
    first_ones = kinds.join(few, "gram").select(_mark_column(F.col("whole"), first).alias("mark"))
    shape = f"gram bigint, whole bigint, id {kind}, key bigint, first bigint, words binary"
    contexts = texts.mapInArrow(_contexts(member_filter(few), member_filter(first_ones), length, gram), shape)
    contexts = contexts.repartition("gram").sortWithinPartitions("gram", "whole", "id", "first")
    spans.append(contexts.mapInArrow(_streamed(length), f"id {kind}, key bigint, start bigint, end bigint"))
    hottest = several.filter(F.col("kinds") > hot_kinds).select("gram")
    if not hottest.isEmpty():
        hot = member_filter(hottest)
        windows = texts.mapInArrow(_hot_windows(hot, length, gram), f"window binary, id {kind}, key bigint, start bigint")
        windows = kept_table(windows, "windows")
        end = (F.col("start") + length).alias("end")
        spans.append(windows.filter("window IS NULL").select("id", "key", "start", end))
        windows = windows.filter("window IS NOT NULL")
        same = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), *least).filter("n > 1").drop("n")
        spans.append(windows.join(same, "window").filter(later).select("id", "key", "start", end))
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    return kept_table(out, "spans")


def _cut_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    words = text.split()
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(words)]
    return len(words), b" ".join(word for a, b in zip(edges[::2], edges[1::2]) for word in words[a:b])


def _document_key(text: bytes, doc_id) -> bytes:
    return _digest(b"%d %s" % (_short(text), str(doc_id).encode()))


def _document_keys(spans: DataFrame) -> DataFrame:
    """Spans by the key of text and doc_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("key").to_pylist(), batch.column("id").to_pylist())
            keys = [_digest(b"%d %s" % (short, str(doc_id).encode())) for short, doc_id in own]
            yield pa.record_batch([pa.array(keys, pa.binary()), batch.column("start"), batch.column("end")], names=["key", "start", "end"])

    return spans.mapInArrow(run, "key binary, start bigint, end bigint")


def remove_substrings(docs: DataFrame, carry: list[str], length: int = LENGTH, **options) -> DataFrame:
    """``row`` (a struct of the carried columns), ``n_words, n_removed, n_spans, kept`` (the kept words, joined by one
    space) of every row.

    Words are runs of bytes other than space and tab to carriage return. A word is removed if a window of ``length``
    words that covers it also starts earlier: in a document of a smaller doc_id, or earlier in one of the same doc_id.
    Windows are judged on the input. A null doc_id counts as smaller than any other; rows of one doc_id, the null one
    too, remove nothing from each other. A null text has no word. Columns of ``docs`` may
    have any name; an empty table gives no row.
    """
    spans = _document_keys(earlier_spans(docs, length, **options))
    cut = cut_out(docs, carry, spans, _document_key, _cut_words)
    kept = F.col("kept").cast("string").alias("kept")
    return cut.select("row", F.col("n_units").alias("n_words"), "n_removed", "n_spans", kept)


def substring_report(docs: DataFrame, **options) -> DataFrame:
    return remove_substrings(docs, ["doc_id"], **options).select("row.doc_id", "n_words", "n_removed", "n_spans", "kept")
