"""Byte-pair encoding with word ends: merge rounds over many words at once, and decoding.

A vocabulary file of the tokenizers library names the normaliser, the split and the merges. Distinct words of a
task's texts are encoded together: their symbols lie in one flat array, each round looks up the ranks of all adjacent
pairs by binary search over the sorted pair keys and merges the lowest pair of every word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.tables import offsets, own_rows, spread, text_chunks

# A task forgets the words it has encoded when they are more than this, to bound its memory.
CACHE_WORDS = 1 << 17
CHUNK_BYTES = 1 << 20
_NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: the printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


class WordBPE:
    """The encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [part["type"] for part in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [step["type"] for step in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only lower-cased, byte-level BPE with word ends can be read")
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        # The file's \s is the Unicode property.
        self.split = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.space = regex.compile(r"\p{White_Space}+")
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[letter] for letter in letters], np.int64)
        self.final = np.array([vocab[letter + end] for letter in letters], np.int64)
        self.base = 1 << int(max(max(vocab.values()), max(added.values(), default=0))).bit_length()
        pairs = [(vocab[a] * self.base + vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([key for key, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([token for _, token in pairs], np.int64)
        tokens = {token: text for text, token in [*vocab.items(), *added.items()]}
        self.names = pa.array([tokens.get(token, "") for token in range(max(tokens) + 1)])

    def words(self, text: str) -> list[str | int]:
        """The words of a text after normalising; special tokens as their ids."""
        if self.special is None or not (cuts := list(self.special.finditer(text))):
            return self._plain(text)
        out: list[str | int] = []
        start = 0
        for cut in cuts:
            out += self._plain(text[start : cut.start()])
            out.append(self.added[cut[0]])
            start = cut.end()
        return out + self._plain(text[start:])

    def _plain(self, text: str) -> list[str]:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # Lower-casing goes letter by letter: a final capital sigma is no special case.
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        raw = [word.encode() for word in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [symbols[:0]], [word[:0]]
        while len(symbols):
            rank = np.full(len(symbols), _NO_RANK)
            keys = symbols[:-1] * self.base + symbols[1:]
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = (self.pair_keys[place] == keys) & (word[:-1] == word[1:])
            rank[:-1][known] = self.pair_ranks[place[known]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            each = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            finished = each == _NO_RANK
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
            merge = (rank == each) & ~finished
            # Of pairs that overlap, as in a run of one letter, every other one from the left is merged.
            chained = merge.copy()
            chained[1:] &= merge[:-1]
            if chained.any():
                at = np.arange(len(merge))
                run_start = np.maximum.accumulate(np.where(merge & ~chained, at, 0))
                merge &= (at - run_start) % 2 == 0
            at = np.flatnonzero(merge)
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            keep = ~finished
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))


class _Encoder:
    """Encodes texts and keeps the ids of the words met so far in a task."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe
        self.forget()

    def forget(self) -> None:
        self.at: dict[str | int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str | int]) -> None:
        plain = [word for word in words if isinstance(word, str)]
        ids, counts = self.bpe.encode_words(plain)
        special = [word for word in words if not isinstance(word, str)]
        ids = np.concatenate([ids, np.array(special, np.int64)]).astype(np.int32)
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        self.at.update(zip([*plain, *special], range(len(self.at), len(self.at) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + offsets(counts)[:-1]])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text starts (and the last ends)."""
        split = [self.bpe.words(text) for text in texts]
        met = set()
        for words in split:
            met.update(words)
        if len(self.at) > CACHE_WORDS:
            self.forget()
        if new := [word for word in met if word not in self.at]:
            self.learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.empty(int(sizes.sum()), np.int64)
        begins = offsets(sizes)
        for begin, words in zip(begins.tolist(), split):
            at[begin : begin + len(words)] = list(map(self.at.__getitem__, words))
        counts = self.counts[at]
        return self.ids[spread(self.starts[at], counts)], offsets(counts)[begins]


_loaded: dict[str, WordBPE] = {}


def _load(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _joined(bpe: WordBPE, ids: pa.Array, begins: np.ndarray) -> pa.Array:
    """The tokens of each list of ids, with a space between."""
    lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), bpe.names.take(ids))
    return pc.binary_join(lists, " ").cast(pa.string())


def encode(docs: DataFrame, path: str, carry: list[str], back: bool = False) -> DataFrame:
    """``row`` (a struct of the carried columns) and the token ``ids`` of every row's whole text; with ``back`` the text
    ``decoded`` from them as well, as ``decode`` does.

    The text is normalised, split and merged as the vocabulary file says; its special tokens are found in the raw text.
    ``path`` must be readable on every executor. A null text is an empty one, with no id; columns of ``docs`` may have
    any name.
    """
    own, kind = own_rows(docs, carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(_load(path))
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES):
                ids, begins = encoder(texts)
                flat = pa.array(ids)
                columns = [batch.column("row").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), flat)]
                if back:
                    columns.append(_joined(encoder.bpe, flat, begins))
                yield pa.record_batch(columns, names=["row", "ids", "decoded"][: len(columns)])

    return own.mapInArrow(run, f"row {kind}, ids array<int>" + ", decoded string" * back)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of token ids: the vocabulary's tokens, special ones too, with a space between.

    The file names no decoder, so tokens stand as they are, word ends included. A null is an empty text.
    """

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return _joined(_load(path), column.flatten(), offsets(sizes))

    return decoded(ids)


def encoded_report(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    return encode(docs, path, ["doc_id"], back=True).select("row.doc_id", "ids", "decoded")
