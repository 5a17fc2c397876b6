"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

A label belongs to a document, an insult to one of its sentences, and there to a word that may be spelt with gaps or
inserted characters. The kernel compares words; a sentence scores as its most toxic word; a document is judged
by its two most toxic words. Where words alone leave toxic documents unexplained, a second machine compares pairs of
words that follow each other, by the product of the kernels of their first and of their second words. Training goes back and forth between picking each toxic document's sentence and word (the highest
score so far) and fitting the machine, with the highest-scoring words of clean documents as the other side.

As the kernel is an inner product of sparse features, the machine over the landmarks becomes one weight for each
feature, so each distinct word of a task's texts is scored once, without a look at the landmarks again.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.llm.tables import checkpointed, held_out, offsets, own_rows, text_chunks
from usagemill.llm.word_kernel import LONGEST, PIECE, FeatureTable, WordKernel

# The machine is fitted on at most so many labelled documents of each class, of different texts, the ones of the
# smallest text hashes, and on the words of so many of their sentences, drawn from all over the text. Scoring has no
# such bound.
TRAIN_DOCUMENTS = 1500
TRAIN_SENTENCES = 400
LANDMARKS = 160
ALIKE = 0.85  # landmarks more alike than this add nothing
BACKGROUND = 32
RANDOM_WORDS = 4000
PAIRS = 64
PAIR_EXCESS = 5.0  # standard errors by which a pair must be more common in unexplained toxic documents
ROUNDS = 4
CLEAN_COST = 2.0  # of a word's share of clean documents, against its share as the word of toxic ones
CACHE_WORDS = 1 << 17
CHUNK_BYTES = 1 << 20

_MARK = "\0"  # before a piece of a long word: no letter, so the kernel does not see it; pieces are in no pairs
_SPACED = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
_EDGES = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~"
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")


def _pieces(word: str) -> list[str]:
    """A word from its first letter to its last, a long one in pieces of PIECE letters that overlap by half, each marked;
    gaps count as none."""
    places = [i for i, letter in enumerate(word) if letter.isalpha()]
    if len(places) <= LONGEST:
        return [word[places[0] : places[-1] + 1]] if places else []
    half = PIECE // 2
    starts = range(0, max(1, len(places) - half), half)
    return [_MARK + word[places[at] : places[min(at + PIECE, len(places)) - 1] + 1] for at in starts]


def words_of(text: str) -> list[str]:
    """Lower-cased words in order, long ones cut to pieces; after an empty word, letters that stand alone in a row, over
    any white space, joined to one word."""
    text = text.lower()
    words = [word.strip(_EDGES) for word in text.split()]
    spaced = ["".join(found.group().split()) for found in _SPACED.finditer(text)]
    words += ["", *spaced] if spaced else []
    if any(len(word) > LONGEST for word in words):
        words = [piece for word in words for piece in (_pieces(word) if len(word) > LONGEST else [word])]
    return words


def _drawn(text: str) -> str:
    """The sentences of a text, or TRAIN_SENTENCES of them at even distances."""
    ends = [found.end() for found in _SENTENCE.finditer(text)]
    starts = [0, *ends]
    if text[starts[-1] :].strip():
        ends.append(len(text))
    if len(ends) <= TRAIN_SENTENCES:
        return text
    chosen = [i * len(ends) // TRAIN_SENTENCES for i in range(TRAIN_SENTENCES)]
    return "\n".join(text[starts[i] : ends[i]] for i in chosen)


def _train_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for first, texts in text_chunks(batch, "text"):
            words = [words_of(_drawn(text)) for text in texts]
            labels = pa.array(toxic[first : first + len(texts)], pa.int32())
            yield pa.record_batch([labels, pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> list[tuple[int, list[str]]]:
    """Labels and words in order of a bounded sample of documents that may be learned from."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    # The ids of the sample are chosen first, so that texts of others are not sorted.
    order = own.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    order = order.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))  # copies count once
    picked = [order.filter(F.col("toxic") == label).orderBy("h").limit(bound) for label in (0, 1)]
    chosen = checkpointed(picked[0].unionByName(picked[1])).select("doc_id", "toxic").distinct()
    rows = own.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most 2 * bound ids
    rows = rows.mapInArrow(_train_words, "toxic int, words array<string>")
    return [(row["toxic"], list(map(sys.intern, row["words"]))) for row in rows.toLocalIterator()]


@dataclass
class Pairs:
    """A machine on pairs of words, by feature tables of the landmarks' first and second words and a weight for each."""

    first: FeatureTable
    second: FeatureTable
    weights: np.ndarray
    bias: float

    def hits(self, firsts: np.ndarray, seconds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Scores over 0 of the different pairs of neighbours; ``ids`` has each word's row in the two tables of kernel values."""
        found: dict[tuple[int, int], float] = {}
        for start in range(0, len(ids) - 1, 1 << 14):
            a, b = ids[start : start + (1 << 14)], ids[start + 1 : start + 1 + (1 << 14)]
            a = a[: len(b)]
            scores = (firsts[a] * seconds[b]) @ self.weights + self.bias
            over = np.flatnonzero(scores > 0)
            found.update(zip(zip(a[over].tolist(), b[over].tolist()), scores[over].tolist()))
        return np.array(list(found.values()))


@dataclass
class Model:
    kernel: WordKernel
    table: FeatureTable
    bias: float
    logistic: np.ndarray
    pairs: Pairs | None

    def words(self, words: list[str]) -> np.ndarray:
        return self.kernel.project(words, self.table)[:, 0] + self.bias

    def chance(self, top: np.ndarray) -> np.ndarray:
        """The chance of label 1, from the two highest scores of the distinct words of each text."""
        sums = np.clip(top, -2, 2) @ self.logistic[:2] + self.logistic[2]
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _svm(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray, start: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights and bias of the squared-hinge machine, by accelerated gradient steps.

    Each row counts with a cost for either side: ``toxic`` if it falls short of 1, ``clean`` if it exceeds -1.
    """
    data = np.concatenate([z, np.ones((len(z), 1), np.float32)], axis=1).astype(np.float32)
    toxic, clean = toxic.astype(np.float32), clean.astype(np.float32)
    ridge = np.append(np.full(z.shape[1], 1e-3), 0).astype(np.float32)
    bound = 2 * np.linalg.eigvalsh((data * (toxic + clean)[:, None]).T @ data)[-1] + ridge.max()
    w = ahead = start.astype(np.float32)
    for step in range(steps):
        f = data @ ahead
        pull = toxic * np.maximum(0, 1 - f) - clean * np.maximum(0, 1 + f)
        after = ahead - (ridge * ahead - 2 * (pull @ data)) / bound
        ahead = after + np.float32(step / (step + 3)) * (after - w)
        w = after
    return w


def top_two(scores: np.ndarray, bias: float) -> tuple[float, float]:
    """The two highest scores of a document's words, from worst to worse where there are less."""
    if len(scores) < 2:
        return (float(scores[0]) if len(scores) else bias, min(bias, 0.0))
    second, first = np.partition(scores, len(scores) - 2)[-2:]
    return float(first), float(second)


def _logistic(top: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights (none below 0) of the two scores and a constant for the chance of label 1, by Newton's steps."""
    data = np.concatenate([np.clip(top, -2, 2), np.ones((len(top), 1))], axis=1)
    used = [0, 1, 2]
    while True:
        part, weights = data[:, used], np.zeros(len(used))
        ridge = np.diag([1e-2] * (len(used) - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ weights, -30, 30)))
            gradient = part.T @ (p - labels) + ridge @ weights
            hessian = (part * (p * (1 - p) + 1e-6)[:, None]).T @ part + ridge
            change = np.linalg.solve(hessian, gradient)
            weights = weights - change / max(1.0, np.abs(change).max() / 5)
            if np.abs(change).max() < 1e-6:
                break
        if (weights[:-1] >= 0).all():
            out = np.zeros(3)
            out[used] = weights
            return out
        used.pop(int(np.argmin(weights[:-1])))


def _whitened(inner: np.ndarray) -> np.ndarray:
    """K^-1/2 on the landmarks' span."""
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    sound = values > 1e-4
    return vectors[:, sound] / np.sqrt(values[sound])


def _fit_pairs(kernel: WordKernel, vocabulary: list[str], runs: list[np.ndarray], labels: np.ndarray, scores: np.ndarray) -> Pairs | None:
    """The machine on pairs of neighbours without a toxic word; none if no pair stands out in the toxic documents that no
    word explains. ``runs`` are the documents' words in order."""
    size = len(vocabulary)
    lettered = np.array([any(map(str.isalpha, word)) for word in vocabulary], bool)
    explained = np.array([len(run) and scores[run].max() > 0 for run in runs], bool)
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for run, label, known in zip(runs, labels.tolist(), explained):
        if label == 0 or not known:
            a, b = run[:-1], run[1:]
            plain = (scores[a] <= 0) & (scores[b] <= 0) & lettered[a] & lettered[b]
            counts[label].update(np.unique(a[plain] * size + b[plain]).tolist())
    total = {0: int(np.sum(labels == 0)), 1: int(np.sum((labels == 1) & ~explained))}
    least = max(2, int(np.sum(labels == 1)) / 200)

    def excess(pair: int) -> float:
        p, q = counts[1][pair] / total[1], counts[0][pair] / total[0]
        spread = (p * (1 - p) + 1 / total[1]) / total[1] + (q * (1 - q) + 1 / total[0]) / total[0]
        return (p - q) / spread**0.5

    ranked = sorted((-excess(pair), pair) for pair, times in counts[1].items() if times >= least)
    marked = [pair for less, pair in ranked if -less >= PAIR_EXCESS][:PAIRS]
    if not marked:
        return None
    firsts, seconds = ([vocabulary[i] for i in part] for part in np.divmod(np.array(marked), size))
    inner = kernel.gram(firsts, firsts).astype(np.float64) * kernel.gram(seconds, seconds)
    to_map = _whitened(inner)
    near = kernel.gram(vocabulary, firsts), kernel.gram(vocabulary, seconds)
    other = np.array(sorted(counts[0].keys() - set(marked)), np.int64)
    closest = np.zeros(len(other), np.float32)
    for start in range(0, len(other), 1 << 16):
        part = other[start : start + (1 << 16)]
        closest[start : start + (1 << 16)] = (near[0][part // size] * near[1][part % size]).max(axis=1)
    hard = other[np.argsort(-closest, kind="stable")[:RANDOM_WORDS]]
    some = np.random.default_rng(0).permutation(other)[:RANDOM_WORDS]
    rows = np.unique(np.concatenate([np.array(marked, np.int64), hard, some]))
    z = (near[0][rows // size] * near[1][rows % size]) @ to_map
    toxic = np.array([counts[1][pair] / total[1] if pair in set(marked) else 0.0 for pair in rows.tolist()])
    clean = np.array([max(counts[0][pair], 0.5) / total[0] for pair in rows.tolist()])
    weights = _svm(z, toxic, CLEAN_COST * clean, np.zeros(to_map.shape[1] + 1))
    tables = [kernel.table(part, np.eye(len(part), dtype=np.float32)) for part in (firsts, seconds)]
    return Pairs(*tables, (to_map @ weights[:-1]).astype(np.float32), float(weights[-1]))


def fit(sample: list[tuple[int, list[str]]]) -> Model | None:
    """The machine of a sample; none if it lacks a class."""
    labels = np.array([label for label, _ in sample])
    if not len(labels) or labels.min() == labels.max():
        return None
    bags = [sorted(set(words)) for _, words in sample]
    counts = {label: Counter(word for bag, own in zip(bags, labels) if own == label for word in bag) for label in (0, 1)}
    kernel = WordKernel()
    total = {label: int(np.sum(labels == label)) for label in (0, 1)}

    def excess(word: str) -> float:
        p, q = counts[1][word] / total[1], counts[0][word] / total[0]
        spread = (p * (1 - p) + 1 / total[1]) / total[1] + (q * (1 - q) + 1 / total[0]) / total[0]
        return (p - q) / spread**0.5

    def landmark_words() -> list[str]:
        """Words of toxic documents by excess, none too like one before; then the most common others."""
        candidates = [word for word in counts[1] if any(map(str.isalpha, word))]
        ranked = sorted(candidates, key=lambda word: (-excess(word), word))
        least = max(2, total[1] / 200)
        ranked = [word for word in ranked if counts[1][word] >= least][: 8 * LANDMARKS] or ranked[: 8 * LANDMARKS]
        alike = kernel.gram(ranked, ranked) if ranked else np.zeros((0, 0))
        marked: list[int] = []
        for i in range(len(ranked)):
            if len(marked) < LANDMARKS and (not marked or alike[i, marked].max() < ALIKE):
                marked.append(i)
        common = sorted(counts[0].keys() - {ranked[i] for i in marked}, key=lambda word: (-counts[0][word], word))
        return [ranked[i] for i in marked] + common[:BACKGROUND]

    landmarks = landmark_words()
    if not landmarks:
        return None
    inner = kernel.gram(landmarks, landmarks).astype(np.float64)
    to_map = _whitened(inner)

    vocabulary = sorted(set().union(*bags))
    number = {word: i for i, word in enumerate(vocabulary)}
    held = [np.array([number[word] for word in bag], np.int64) for bag in bags]
    clean_rate = np.array([counts[0][word] for word in vocabulary]) / total[0]
    toxic_rate = np.array([counts[1][word] for word in vocabulary]) / total[1]
    some = np.random.default_rng(0).permutation(len(vocabulary))[:RANDOM_WORDS]
    marked = np.array([number[word] for word in landmarks], np.int64)
    weights = np.zeros(to_map.shape[1] + 1)
    scores = np.zeros(len(vocabulary))
    witness = toxic_rate  # at first each word of a toxic document may be the one
    hard = np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        if turn:
            best = [bag[np.argmax(scores[bag])] for bag, label in zip(held, labels) if label == 1 and len(bag)]
            chosen = np.bincount(best, minlength=len(vocabulary)) / total[1]
            witness = np.where(scores > 0, np.maximum(toxic_rate, chosen), 0)
            hard = [bag[np.argsort(-scores[bag], kind="stable")[:3]] for bag, label in zip(held, labels) if label == 0 and len(bag)]
            hard = np.concatenate(hard)
        rows = np.unique(np.concatenate([some, marked, hard, np.flatnonzero(witness) if turn else marked]))
        z = kernel.gram([vocabulary[i] for i in rows.tolist()], landmarks) @ to_map
        weights = _svm(z, witness[rows], CLEAN_COST * np.maximum(clean_rate[rows], 0.5 / total[0]), weights)
        beta = (to_map @ weights[:-1]).astype(np.float32)
        table = kernel.table(landmarks, beta[:, None])
        scores = kernel.project(vocabulary, table)[:, 0] + weights[-1]
    runs = [np.array([number[word] for word in words], np.int64) for _, words in sample]
    pairs = _fit_pairs(kernel, vocabulary, runs, labels, scores)
    found = [scores[bag] for bag in held]
    if pairs:
        near = _near(kernel, vocabulary, pairs.first), _near(kernel, vocabulary, pairs.second)
        found = [np.concatenate([own, pairs.hits(*near, run)]) for own, run in zip(found, runs)]
    top = np.array([top_two(own, weights[-1]) for own in found])
    return Model(kernel, table, float(weights[-1]), _logistic(top, labels), pairs)


def _near(kernel: WordKernel, words: list[str], table: FeatureTable) -> np.ndarray:
    """Kernel values of words with the landmarks of a table; 0 for pieces of long words."""
    out = np.zeros((len(words), table.values.shape[1]), np.float32)
    whole = [i for i, word in enumerate(words) if not word.startswith(_MARK)]
    out[whole] = kernel.project([words[i] for i in whole], table)
    return out


def _scorer(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        pairs = model.pairs if model else None
        width = len(pairs.weights) if pairs else 0
        known: dict[str, int] = {}
        table, firsts, seconds = np.zeros(0), np.zeros((0, width), np.float32), np.zeros((0, width), np.float32)
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES):
                if model is None:
                    out = np.zeros(len(texts))
                else:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                        table, firsts, seconds = table[:0], firsts[:0], seconds[:0]
                    runs = [words_of(text) for text in texts]
                    split = [set(words) for words in runs]
                    new = [word for word in set().union(*split) if word not in known]
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    table = np.concatenate([table, model.words(new)])
                    scores = [table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))] for words in split]
                    if pairs:
                        firsts = np.concatenate([firsts, _near(model.kernel, new, pairs.first)])
                        seconds = np.concatenate([seconds, _near(model.kernel, new, pairs.second)])
                        ids = (np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in runs)
                        scores = [np.concatenate([own, pairs.hits(firsts, seconds, each)]) for own, each in zip(scores, ids)]
                    out = model.chance(np.array([top_two(own, model.bias) for own in scores]))
                yield pa.record_batch([batch.column("row").slice(first, len(texts)), pa.array(out)], names=["row", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, carry: list[str], bound: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``row`` (a struct of the carried columns) and the toxicity ``score``, 0 to 1, of every row's whole text.

    Learns from the text of at most ``bound`` documents of each label; rows whose crc32(doc_id) mod 5 is 0 are never
    learned from, and a document that is labelled more than once counts as toxic if any label says so. A null or empty
    text has no word and scores as one without any sign of toxicity. If a class is missing, every score is 0. A text
    of any length is scored whole; rows that repeat have the same score. Columns of ``docs`` may have any name; an empty
    table gives no row. Scoring shuffles nothing.
    """
    model = fit(_sample(docs, labels, bound))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 5 MB for each of one to three feature tables, and their values
    own, kind = own_rows(docs, carry)
    return own.mapInArrow(_scorer(shared), f"row {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs, labels, ["doc_id"])
    return scored.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not judged toxic, with all their columns."""
    return score(docs, labels, docs.columns).filter("score < 0.5").select("row.*")
