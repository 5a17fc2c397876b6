"""Language of texts: a chain over their words, so that mixed texts get a language for each word."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.llm.crf import LONGEST, Chain, fit, letter_pieces, marginals
from usagemill.llm.tables import checkpointed, held_out, offsets, own_rows, text_chunks

# The chain is fitted on at most so many different texts of each language, the ones of the smallest hashes, and on at
# most so many words of each, drawn from all over the text. Prediction has no such bound.
TRAIN_DOCUMENTS = 300
TRAIN_WORDS = 240
BUCKETS = 8
MIXED_TEXTS = 4000
CHUNK_BYTES = 6 << 20
CACHE_WORDS = 1 << 18
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words; a run of letters over LONGEST, as in scripts without spaces, is several."""
    words = _WORD.findall(text.lower())
    if any(len(word) > LONGEST for word in words):
        words = [piece for word in words for piece in (letter_pieces(word) if len(word) > LONGEST else [word])]
    return words


def _train_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of 24 words, at even distances in the text."""
    for batch in batches:
        for first, texts in text_chunks(batch, "text"):
            out = []
            for text in texts:
                words = words_of(text)
                starts = range(0, len(words), 24)
                stride = max(1, -(-len(starts) * 24 // TRAIN_WORDS))
                out.append([words[start : start + 24] for start in starts[::stride]])
            lang = batch.column("lang").slice(first, len(texts))
            yield pa.record_batch([lang, pa.array(out, pa.list_(pa.list_(pa.string())))], names=["lang", "pieces"])


def _chosen(own: DataFrame, bound: int) -> DataFrame:
    """``doc_id, lang`` of at most ``bound`` documents of each language, of different texts, those of the smallest hashes.

    Hashes deal the texts of a language into buckets, of which tasks send the smallest each; so the last choice sees
    at most ``BUCKETS`` rows for each of ``bound``, however many documents or copies a language has.
    """
    bucket = F.pmod("h", F.lit(BUCKETS * bound)).alias("bucket")
    hashed = own.select("lang", F.struct(F.xxhash64("text").alias("h"), "doc_id").alias("one"), F.xxhash64("text").alias("h"))
    least = hashed.groupBy("lang", bucket).agg(F.min("one").alias("one")).select("lang", "one.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return least.withColumn("n", place).filter(F.col("n") <= bound).select("doc_id", "lang")


def train(docs: DataFrame, bound: int = TRAIN_DOCUMENTS) -> Chain | None:
    """The chain learned from text and lang of a bounded sample of documents that may be learned from."""
    own = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    own = own.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.filter("doc_id IS NOT NULL")
    chosen = checkpointed(_chosen(own, bound))
    pieces = own.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("lang", "text")  # bound ids a language
    rows = pieces.mapInArrow(_train_words, "lang string, pieces array<array<string>>")
    by_lang: dict[str, list[list[str]]] = {}
    for row in rows.toLocalIterator():
        by_lang.setdefault(row["lang"], []).extend(piece for piece in row["pieces"] if piece)
    by_lang = {lang: sorted(pieces) for lang, pieces in sorted(by_lang.items()) if pieces}
    if not by_lang:
        return None
    labels = list(by_lang)
    draw = np.random.default_rng(0)
    texts = []
    for _ in range(MIXED_TEXTS):
        # One to three pieces, of any languages: the chain learns where a text goes over from one to another.
        words, gold = [], []
        for _ in range(draw.integers(1, 4)):
            label = int(draw.integers(len(labels)))
            own_pieces = by_lang[labels[label]]
            piece = own_pieces[int(draw.integers(len(own_pieces)))]
            words += piece
            gold += [label] * len(piece)
        texts.append((words, np.array(gold)))
    return fit(labels, texts)


def _predictor(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain | None = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(chain.labels) if chain else 1), np.float32)
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES):
                split = [words_of(text) for text in texts] if chain else [[] for _ in texts]
                if len(known) > CACHE_WORDS:
                    known.clear()
                    table = table[:0]
                met = set()
                for words in split:
                    met.update(words)
                new = [word for word in met if word not in known]
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    table = np.concatenate([table, chain.emissions(new)])
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                ids = np.empty(int(sizes.sum()), np.int64)
                begin = 0
                for words in split:
                    ids[begin : begin + len(words)] = list(map(known.__getitem__, words))
                    begin += len(words)
                row = batch.column("row").slice(first, len(texts))
                yield pa.record_batch([row, *_labelled(table[ids], sizes, chain)], names=["row", "spans", "chances"])

    return run


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("chance", pa.float64())])


def _labelled(emissions: np.ndarray, sizes: np.ndarray, chain: Chain | None) -> tuple[pa.Array, pa.Array]:
    """Of each text the runs of words that most likely have one label, and the mean chance of each label."""
    begins = offsets(sizes)
    if not len(emissions):
        nothing = pa.array(np.zeros(len(sizes) + 1, np.int32))
        return pa.ListArray.from_arrays(nothing, pa.array([], _SPAN)), pa.ListArray.from_arrays(nothing, pa.array([], pa.float64()))
    full = sizes > 0
    chances = marginals(emissions, sizes[full], chain.move)
    means = np.add.reduceat(chances, begins[:-1][full], axis=0, dtype=np.float64) / sizes[full][:, None]
    lists = pa.array(offsets(np.where(full, means.shape[1], 0)).astype(np.int32))
    best = chances.argmax(axis=1)
    new = np.concatenate([[True], best[1:] != best[:-1]])
    new[begins[:-1][full]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(best))
    owner = np.searchsorted(begins, starts, "right") - 1
    chance = np.add.reduceat(chances[np.arange(len(best)), best], starts, dtype=np.float64) / (ends - starts)
    columns = [starts - begins[owner], ends - begins[owner], best[starts].astype(np.int32), np.clip(chance, 0, 1)]
    spans = pa.StructArray.from_arrays([pa.array(column) for column in columns], fields=list(_SPAN))
    edges = offsets(np.bincount(owner, minlength=len(sizes)))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), spans), pa.ListArray.from_arrays(lists, pa.array(np.clip(means, 0, 1).ravel()))


def label_words(docs: DataFrame, carry: list[str], chain: Chain | None) -> DataFrame:
    """``row`` (a struct of the carried columns), ``spans`` and ``chances`` of every row's whole text.

    ``spans`` are runs of words that most likely have one language: ``start, end`` in words, ``lang``, and ``chance``, the mean
    chance of it over these words, by forward and backward sums over the chain. ``chances`` are those of all languages
    (``chain.labels``, in order) over all words. Words are runs of letters; of a run of over 24 letters each piece counts
    as one. A null text, or one without a letter, has neither; so has any text if nothing could be learned. Rows that repeat are
    labelled each; columns of ``docs`` may have any name; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a fixed number of features for each language
    own, kind = own_rows(docs, carry)
    shape = f"row {kind}, spans array<struct<start:bigint,end:bigint,label:int,chance:double>>, chances array<double>"
    labels = _labels(chain)
    named = F.transform("spans", lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), F.get(labels, span["label"]).alias("lang"), span["chance"].alias("chance")))
    return own.mapInArrow(_predictor(shared), shape).select("row", named.alias("spans"), "chances")


def _labels(chain: Chain | None) -> Column:
    return F.array(*map(F.lit, chain.labels if chain else [])).cast("array<string>")


def predict(docs: DataFrame, carry: list[str], chain: Chain | None) -> DataFrame:
    """``label_words`` with ``lang_pred``, the language that most of the text's words are expected to have (the first of
    equal ones), and ``score``, its mean chance over all words; ``und`` and 0 for a text that has no chances."""
    top = F.array_max("chances")
    found = F.get(_labels(chain), F.array_position("chances", top).cast("int") - 1)
    labelled = label_words(docs, carry, chain)
    return labelled.select("row", F.coalesce(found, F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(top, F.lit(0.0)).alias("score"), "spans", "chances")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; rows whose crc32(doc_id) mod 5 is 0 are not learned from."""
    found = predict(docs, ["doc_id"], train(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
