"""Byte-level BPE against the library that the rank files are made for."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
from collections import Counter

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from usagemill.llm import byte_bpe
from usagemill.llm.queries import op12_byte_bpe
from usagemill.llm.tables import documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = public_tokenizers.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe._Encoder(byte_bpe.RankBPE(path), public_tokenizers.PATTERN), known


def same(pair, texts):
    encoder, known = pair
    ids, begins = encoder(texts)
    for i, text in enumerate(texts):
        assert ids[begins[i] : begins[i + 1]].tolist() == known.encode_ordinary(text), text[:60]
    assert encoder.bpe.decode(ids, begins).to_pylist() == [text.encode() for text in texts]


def test_code_points(pair):
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    same(pair, ["".join(letters[i : i + 997]) for i in range(0, len(letters), 9970)])
    same(pair, [f"a{one} {one}b" for one in letters[:0x3000]])


def test_random_words(pair):
    rng = random.Random(4)
    alphabets = ["ab", "etaoin shrdlu", "aA1 .\n\t'", "日本語中文字", "абвгд ", "  \x1c \r\n", "😀👍🏽é"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(120))) for _ in range(600)]
    same(pair, texts)


def test_long_words(pair):
    rng = random.Random(5)
    runs = ["a" * 20_001, " " * 5_000 + "x", "=-" * 3_000, "ha" * 4_999, "the" * 2_000, "日本" * 1_500, "\n" * 777]
    glued = ["".join(rng.choices(["the", "and", "ing", "tion", "er", "qu", "stra"], k=900)), "".join(rng.choices("ACGT", k=3_000))]
    same(pair, runs + glued + ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3_000))])


def test_all_paths_agree(pair, monkeypatch):
    """Short and long query, few rounds a query, words forgotten at once."""
    texts = ["Whether 'tis nobler in the mind to suffer the slings and arrows " * 3, "aaaa aaaaa aa", "counterrevolutionaries"]
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    monkeypatch.setattr(byte_bpe, "ROWS", 1)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 0)
    same(pair, texts)
    same(pair, texts)


def test_rows(awkward, empty):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    got = byte_bpe.encoded_report(awkward, PATH, public_tokenizers.PATTERN).collect()
    want = Counter((r["doc_id"], tuple(known.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in awkward.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert byte_bpe.encoded_report(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_decode_column(spark):
    docs = documents(spark, "/root/testdata/sf0.001").withColumn("ids", F.lit("x"))
    coded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, ["doc_id", "ids", "text"])
    back = coded.select("row.text", byte_bpe.decode(F.col("ids"), PATH).alias("back"))
    assert back.filter("NOT (coalesce(text, '') <=> decode(back, 'UTF-8'))").count() == 0


def test_query(spark):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    want = {}
    for row in documents(spark, "/root/testdata/sf0.01").collect():
        ids = known.encode_ordinary(row["text"] or "")
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want[row["doc_id"]] = (len(ids), packed, hashlib.sha256((row["text"] or "").encode()).hexdigest())
    got = op12_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert {row["doc_id"]: (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) for row in got} == want
