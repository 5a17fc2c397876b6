from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

COLUMNS = "doc_id bigint, text string, lang string, row string, key string, text_sha256 string"


def sentences(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(1, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, short and long texts, copies, shared passages, self-repeats, a repeated row, clashing names."""
    passage = sentences(1, 150)
    base = [sentences(seed, 120) for seed in range(2, 12)]
    texts = [None, "", " \t\n", "One", "two WORDS", "a" * 900, "é" * 500, sentences(99, 12_000), "ab " * 700]
    texts += base + base[:3] + [base[3] + "!", base[4].replace(" ", "  "), base[5].upper()]
    texts += [f"{sentences(20 + i, 40)} {passage} {sentences(40 + i, 30)}" for i in range(6)]
    texts += [f"{base[6]}\n{base[6]}", "x" * 399, "x" * 400, "<|endoftext|> Don't STOP 123", "idiot"]
    rows = [Row(i * 3, text, "en", "r", "k", "s") for i, text in enumerate(texts)]
    rows += [rows[12], Row(None, base[0], "en", "r", "k", "s"), Row(None, "lone text", None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
