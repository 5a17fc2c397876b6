"""The Merkle manifest against plain code, and positions by bitmaps against a sort."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagemill.llm import merkle, rank_bitmaps
from usagemill.llm.tables import documents


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves):
    """The top of a tree, and of each leaf the slots and siblings up to it."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place - place % 3
            run = level[first : first + 3]
            paths[i].append((place % 3, run[: place % 3] + run[place % 3 + 1 :]))
            at[i] = place // 3
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        struck = row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        other = row["text"].replace("\n", "") if struck else row["text"]
        groups[row["source"]].append((row["doc_id"], leaf_of(row, row["text"]), leaf_of(row, other)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, found = [], []
    for source in order:
        own = sorted(groups[source], key=lambda one: (one[0] is not None, one[0] or 0, one[1], one[2]))
        top, paths = climb([leaf for _, leaf, _ in own])
        tops.append(top)
        found.append((own, paths))
    out = Counter()
    if not tops:
        return out
    root, stems = climb(tops)
    for (own, paths), top, stem in zip(found, tops, stems):
        for (doc_id, leaf, other), path in zip(own, paths):
            node = other
            for slot, siblings in path + stem:
                node = digest("".join(siblings[:slot] + [node] + siblings[slot:]))
            proof = digest("".join(one for _, siblings in path + stem for one in siblings))
            out[doc_id, leaf, top, root, proof, node, node == root] += 1
    return out


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(row[name] for name in names) for row in merkle.manifest_report(df).collect())


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    assert found(docs) == plain(docs.collect())


@pytest.fixture
def awkward(awkward):
    return awkward.withColumns({"source": F.expr("nullif(doc_id % 4, 1)").cast("string"), "n_chars": F.length("text").cast("bigint")})


def test_awkward_rows(awkward):
    assert found(awkward) == plain(awkward.collect())


def test_empty(awkward):
    assert found(awkward.limit(0)) == Counter()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(i * 7 - 20, f"a\nb{i}", "en", None if i % 3 == 0 else f"s{i % 2}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(docs) == plain(docs.collect())


def test_several_blocks_repeats_and_far_ids(spark, monkeypatch):
    """Trees of many blocks and levels; ids over the whole range; rows that share an id or everything."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "_COPIES", 3)
    rng = random.Random(5)
    rows = []
    for i in range(700):
        doc_id = rng.choice([None, 7, 7, rng.randrange(-(1 << 63), 1 << 63), rng.randrange(100_000), -(1 << 63), i])
        rows.append((doc_id, rng.choice([None, "x\ny", f"t{i}", "same"]), "en", rng.choice(["hot", "hot", None, "z", "é"]), 3))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(docs.repartition(5)) == plain(docs.collect())


@pytest.mark.parametrize("share", [0.01, 0.5, 1.0])
def test_container(share):
    rng = np.random.default_rng(3)
    lows = np.flatnonzero(rng.random(rank_bitmaps.WIDTH) < share).astype(np.uint16)
    counts = rng.integers(1, 4, len(lows))
    box = rank_bitmaps.Container(rank_bitmaps.packed(lows), rank_bitmaps._more(lows, counts))
    assert (rank_bitmaps.unpacked(rank_bitmaps.packed(lows)) == lows).all()
    before, same = box.rank(lows)
    assert (before == np.concatenate([[0], np.cumsum(counts)[:-1]])).all() and (same == counts).all()


def test_clashing_names(spark):
    docs = documents(spark, "/root/testdata/sf0.001").withColumns({name: F.lit("x") for name in ("grp", "id", "leaf", "rank", "row", "tree")})
    assert found(docs) == plain(docs.collect())
