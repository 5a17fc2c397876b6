"""Benchmark decontamination: an FM-index for each shard of documents, searched for the phrases of the benchmark."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.llm.fm_index import FMIndex
from usagemill.llm.tables import byte_chunks, offsets, own_rows
from usagemill.session import fresh_folder
from usagemill.sources.stores import store_of

WINDOW_WORDS = 10
# Documents are searched with so many bytes of benchmark text at a time, which bounds what a task holds of it.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
# Shards that a task searches with one reading of the blocks, if these are read from the shared folder.
SHARDS = 6

# Bytes of words keep their value, A-Z become a-z, all others become a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """The distinct windows of a block of benchmark items, as numbered words, with the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            numbers = [self.words.setdefault(word, len(self.words) + 1) for word in words_of(text)]
            for start in range(max(1, len(numbers) - window + 1) if numbers else 0):
                owners[tuple(numbers[start : start + window])].update([] if item is None else [item])
        self.lengths = np.fromiter(map(len, owners), np.int64, len(owners))
        self.table = np.zeros((len(owners), window), np.int64)
        for row, phrase in zip(self.table, owners):
            row[window - len(phrase) :] = phrase
        self.owners = [sorted(names) for names in owners.values()]


def _search(numbers: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and start of all occurrences in a shard; 0 stands for a word outside all phrases, or between texts.

    Runs of known words that are shorter than every phrase hold none and are left out of the index.
    """
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return none, none
    known = np.concatenate([[False], numbers > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= phrases.lengths.min()
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return none, none
    counts = ends - starts + 1  # and a 0 after each run
    begins = offsets(counts)
    places = np.arange(begins[-1]) + np.repeat(starts - begins[:-1], counts)
    kept = np.append(numbers, 0)[places]
    kept[begins[1:] - 1] = 0
    which, at = FMIndex(kept).occurrences(phrases.table, phrases.lengths)
    return which, places[at]


class _Shard:
    """Some texts of a batch as one row of words, and what the blocks have hit so far."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.split = first, [words_of(text) for text in texts]
        self.counts = np.fromiter(map(len, self.split), np.int64, len(self.split))
        self.begins = offsets(self.counts + 1)  # a 0 between texts
        self.edge = np.zeros(self.begins[-1] + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]

    def search(self, phrases: Phrases) -> None:
        """Indexes the words that a block knows, and marks its phrases."""
        numbers = np.zeros(self.begins[-1], np.int64)
        for begin, words in zip(self.begins[:-1].tolist(), self.split):
            numbers[begin : begin + len(words)] = list(map(phrases.words.get, words, [0] * len(words)))
        which, at = _search(numbers, phrases)
        np.add.at(self.edge, at, 1)
        np.add.at(self.edge, at + phrases.lengths[which], -1)
        owner = np.searchsorted(self.begins, at, "right") - 1
        for text, phrase in np.unique(np.stack([owner, which]), axis=1).T.tolist():
            self.items[text].update(phrases.owners[phrase])

    def columns(self) -> list[pa.Array]:
        hit = np.cumsum(self.edge)[:-1] > 0
        hits = np.add.reduceat(hit, self.begins[:-1]) if len(hit) else np.zeros(0, np.int64)
        bounds = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
        of = np.searchsorted(self.begins, bounds[:, 0], "right") - 1
        spans: list[list[dict]] = [[] for _ in self.split]
        for text, (start, end) in zip(of.tolist(), (bounds - self.begins[of][:, None]).tolist()):
            spans[text].append({"start": start, "end": end})
        return [
            pa.array(self.counts),
            pa.array(hits.astype(np.int64)),
            pa.array([sorted(names) for names in self.items], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]


def _spans(blocks: Callable[[], Iterable[Phrases]], at_once: int):
    """The hits of each text; ``blocks`` gives the phrases a block at a time, once for every ``at_once`` shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = byte_chunks(batch, "text", SHARD_BYTES)
            while shards := [_Shard(first, texts) for first, texts in islice(parts, at_once)]:
                for phrases in blocks():
                    for shard in shards:
                        shard.search(phrases)
                for shard in shards:
                    own = batch.column("row").slice(shard.first, len(shard.split))
                    yield pa.record_batch([own, *shard.columns()], names=["row", "n_words", "n_hit", "items", "spans"])

    return run


def _phrase_blocks(window: int, limit: int):
    """Blocks of the items of a partition, pickled, each of about ``limit`` bytes of text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pickle.dumps(Phrases(block, window))], pa.binary())], names=["block"])

        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.append((item, text))
                size += len(text)
                if size >= limit:
                    yield packed()
                    block, size = [], 0
        if block:
            yield packed()

    return run


def _stored(folder: str) -> Callable[[], Iterator[Phrases]]:
    """Reads blocks from the shared folder, one in memory at a time."""

    def blocks() -> Iterator[Phrases]:
        from pyarrow import fs, parquet

        files, name = store_of(folder, named_by_spark=False)
        for found in files.get_file_info(fs.FileSelector(name)):
            if found.path.endswith(".parquet"):
                with files.open_input_file(found.path) as source:
                    for batch in parquet.ParquetFile(source).iter_batches(batch_size=1):
                        yield from map(pickle.loads, batch.column(0).to_pylist())

    return blocks


def _shared(benchmark: DataFrame, window: int, limit: int) -> tuple[Callable[[], Iterable[Phrases]], int]:
    """For ``_spans``: the phrases where tasks find them: broadcast if the texts are at most one block, else as a table that tasks write
    to the shared folder and read block by block, so that neither the driver nor a task holds the benchmark."""
    spark = benchmark.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= limit:
        items = [(row["item"], bytes(row["text"])) for row in rows.collect()]
        one = spark.sparkContext.broadcast(Phrases(items, window))
        return lambda: [one.value], 1
    folder = fresh_folder(spark, "phrases")
    rows.mapInArrow(_phrase_blocks(window, limit), "block binary").write.parquet(folder)
    return _stored(folder), SHARDS


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``row`` (a struct of the carried columns), ``n_words``, ``n_hit``, ``items`` and ``spans`` of every row.

    Words are runs of 0-9, a-z after A-Z is lower-cased, and all that is not ASCII. A window is ``window`` consecutive
    words of an item, or the whole of a shorter item with a word; ``items`` are the ids, as sorted strings, of the
    items with a window in the document, ``spans`` the merged runs of words (start, end) in such windows, ``n_hit``
    the words in them. A null text has no word; a text of any length is indexed whole. Items of one id are one item; a
    window of an item without an id is hit but names none. With no benchmark nothing is hit. Rows that repeat are
    searched each; columns of ``docs`` may have any name. Each task indexes its own documents in one scan and takes the
    blocks of phrases one after the other: nothing is shuffled.
    """
    own, kind = own_rows(docs, carry)
    out = f"row {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    return own.mapInArrow(_spans(*_shared(benchmark, window, block_bytes)), out)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, contaminated`` of every row."""
    found = find_contamination(docs, benchmark, ["doc_id"], **options)
    return found.select("row.doc_id", "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a word inside a benchmark window, with all their columns."""
    return find_contamination(docs, benchmark, docs.columns, **options).filter("n_hit = 0").select("row.*")
