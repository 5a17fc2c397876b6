"""The random field against an enumeration of all label sequences; word spans of mixed texts."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from usagemill.llm import language
from usagemill.llm.crf import Chain, marginals


def test_chances_are_those_of_all_sequences():
    draw = np.random.default_rng(1)
    lengths, kinds = np.array([3, 1, 5]), 3
    scores, move = draw.normal(size=(9, kinds)), draw.normal(size=(kinds, kinds))
    found, moves = marginals(scores, lengths, move, collect=True)
    want, want_moves, begin = np.zeros((9, kinds)), np.zeros((kinds, kinds)), 0
    for n in lengths.tolist():
        total, own, own_moves = 0.0, np.zeros((n, kinds)), np.zeros((kinds, kinds))
        for labels in product(range(kinds), repeat=n):
            weight = np.exp(sum(scores[begin + i, k] for i, k in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            for i, k in enumerate(labels):
                own[i, k] += weight
            for a, b in zip(labels, labels[1:]):
                own_moves[a, b] += weight
        want[begin : begin + n] = own / total
        want_moves += own_moves / total
        begin += n
    assert np.allclose(found, want) and np.allclose(moves, want_moves) and np.allclose(marginals(scores, lengths, move), want)


def texts(spark):
    english, german = "the house and the garden are with the river", "das haus und der garten sind mit dem fluss"
    rows = [(i, f"{english} {i}" if i % 2 else f"{german} {i}", "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), english, german


def test_spans_of_mixed_text(spark):
    docs, english, german = texts(spark)
    chain = language.train(docs)
    rows = [(1, f"{english} {english} {german} {german}", "a", "b"), (1, f"{english} {english} {german} {german}", "a", "b"), (2, None, None, None),
            (3, "12 !?", "a", "b"), (4, "", "a", "b"), (5, english * 3000, "a", "b")]
    mixed = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, row string")
    found = [row for row in language.predict(mixed, ["doc_id", "spans"], chain).collect()]
    first, again = [row for row in found if row["row"]["doc_id"] == 1]
    assert first == again
    spans = [(span["start"], span["end"], span["lang"]) for span in first["spans"]]
    assert spans[0][0] == 0 and spans[-1][1] == 36 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    english_words = {i for start, end, lang in spans if lang == "en" for i in range(start, end)}
    assert len(english_words & set(range(18))) >= 16 and len(english_words & set(range(18, 36))) <= 2
    assert all(0 < span["chance"] <= 1 for span in first["spans"])
    empty = [row for row in found if row["row"]["doc_id"] in (2, 3, 4)]
    assert {(row["lang_pred"], row["score"], len(row["spans"]), len(row["chances"])) for row in empty} == {("und", 0.0, 0, 0)}
    assert [row["lang_pred"] for row in found if row["row"]["doc_id"] == 5] == ["en"]
    assert language.predict(mixed.limit(0), ["doc_id"], chain).count() == 0
    nothing = language.predict(mixed, ["doc_id"], None).collect()
    assert {(row["lang_pred"], row["score"]) for row in nothing} == {("und", 0.0)}


def test_span_of_one_label():
    chain = Chain(["x"], np.zeros((4, 1), np.float32), np.zeros((1, 1), np.float32))
    spans, chances = language._labelled(np.zeros((3, 1), np.float32), np.array([0, 2, 0, 1]), chain)
    assert [len(one) for one in spans.to_pylist()] == [0, 1, 0, 1] and chances.to_pylist() == [[], [1.0], [], [1.0]]


def test_report_agrees_with_its_spans(spark):
    docs, _, _ = texts(spark)
    chain = language.train(docs)
    for row in language.predict(docs, ["doc_id"], chain).collect():
        words = sum(span["end"] - span["start"] for span in row["spans"])
        assert words == 9 and row["score"] == max(row["chances"])
        assert row["lang_pred"] == chain.labels[int(np.argmax(row["chances"]))]
    assert language.language_report(docs).filter(F.col("held_out") & (F.col("lang_pred") != F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))).count() == 0
