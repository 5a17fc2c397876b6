"""Operators on copies and passages, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from usagemill.llm import exact, gray_index, repeats, simhash, substring_dedup, suffix_dedup
from usagemill.llm.components import components
from usagemill.llm.suffix_sort import SuffixSorter


def rows_of(df):
    return [(row["doc_id"], row["text"]) for row in df.select("doc_id", "text").collect()]


def test_exact(awkward):
    rows = rows_of(awkward)
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = Counter()
    for doc_id, text in rows:
        same = groups[text or ""]
        keep = max((one for one in same if one is not None), default=None)
        want[doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.duplicate_report(awkward).collect())) == want
    kept = exact.exact_dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(text or "" for _, text in rows_of(kept)) == sorted(groups)
    assert sorted(text or "" for _, text in rows_of(exact.exact_dedup(awkward.unionByName(awkward)))) == sorted(groups)


def test_one_row_of_each_near_group_stays(awkward):
    kept = Counter(rows_of(simhash.near_dedup(awkward)))
    twice = awkward.unionByName(awkward.withColumn("lang", F.lit("xx")))
    assert Counter(rows_of(simhash.near_dedup(twice))) == kept
    groups = simhash.near_duplicate_report(awkward).filter("component_id IS NOT NULL").select("component_id").distinct().count()
    assert sum(n for (doc_id, _), n in kept.items() if doc_id is not None) == groups
    assert max(kept.values()) == 1


def test_filter_never_misses_a_repeat(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    seen = repeats.repeat_filter(keys.union(keys.limit(500)), log2=20)
    known = np.array([row["key"] for row in keys.collect()])
    assert seen.may_repeat(np.array([row["key"] for row in keys.limit(500).collect()])).all()
    assert seen.may_repeat(known).mean() < 0.1


@pytest.mark.parametrize("n", [1_000, 300_000, 2_000_000])
def test_filter_grows_with_the_keys(spark, monkeypatch, n):
    """Few unrepeated keys pass, however many there are; a filter that may not grow passes more, and still all repeats."""
    monkeypatch.setattr(repeats, "LEAST_LOG2", 16)
    keys = spark.range(n).select(F.xxhash64("id").alias("key"))
    known = np.array([row["key"] for row in keys.limit(50_000).collect()])
    seen = repeats.repeat_filter(keys.union(keys.limit(100)), repeats.cells_log2(n))
    assert seen.may_repeat(known[:100]).all() and seen.may_repeat(known[100:]).mean() < 0.06
    monkeypatch.setattr(repeats, "MOST_LOG2", 16)
    small = repeats.repeat_filter(keys.union(keys.limit(100)), repeats.cells_log2(n))
    assert small.log2 == 16 and small.may_repeat(known[:100]).all()
    assert repeats.member_filter(keys.limit(100)).may_repeat(known[:100]).all()


def fingerprint(text):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(piece, 42) for piece in pieces]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def linked(codes, limit):
    """The smallest place that each code reaches."""
    best = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if best[j] < best[i] and (int(a) ^ int(b)).bit_count() <= limit:
                    best[i], changed = best[j], True
    return best


def test_simhash(awkward):
    rows = rows_of(awkward)
    codes = [fingerprint(text) for _, text in rows]
    roots = linked(codes, 3)
    smallest = {}
    for (doc_id, _), root in zip(rows, roots):
        known = smallest.get(root)
        smallest[root] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    want = Counter((doc_id, f"{code:016x}", smallest[root]) for (doc_id, _), code, root in zip(rows, codes, roots))
    assert Counter(map(tuple, simhash.near_duplicate_report(awkward).collect())) == want
    kept = simhash.near_dedup(awkward)
    assert kept.columns == awkward.columns
    assert {row["doc_id"] for row in kept.collect()} - {None} == set(smallest.values()) - {None}


@pytest.mark.parametrize("hot", [1, 1 << 16])
def test_links_of_dense_and_sparse_codes(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot)
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [code ^ np.uint64(1 << int(bit)) for code in codes[:10] for bit in draw.integers(0, 64, 12)]
    codes = np.unique(np.concatenate([codes, np.array(near, np.uint64)]))
    frame = spark.createDataFrame([(int(code),) for code in codes.view(np.int64)], "code bigint")
    roots = {row["node"]: row["root"] for row in components(simhash.links(frame, 3)).collect()}
    found = [roots.get(int(code), int(code)) for code in codes.view(np.int64)]
    want = linked(codes.tolist(), 3)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_gray_index_finds_all_links():
    draw = np.random.default_rng(0)
    codes = np.unique(draw.integers(0, 1 << 12, 900, dtype=np.uint64) << np.uint64(20))
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    first = gray_index.group_links(codes, np.zeros(len(codes), np.int64), 1)
    want = linked(codes.tolist(), 1)
    assert first.tolist() == want


def test_chain_is_one_component(spark):
    found = components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert found.select("root").distinct().count() == 1 and found.count() == 301


def cut_repeats(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    times = Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    for (doc_id, _), text in zip(rows, texts):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if times[text[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(byte for byte, out in zip(text, gone) if not out)
        yield doc_id, len(text), sum(gone), len([part for part in bytes(gone).split(b"\0") if part]), kept


@pytest.mark.parametrize("length, options", [(400, {}), (60, {"gram": 12}), (60, {"gram": 12, "hot_kinds": 1})])
def test_suffix_dedup(awkward, length, options, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 5000)
    found = suffix_dedup.repeat_report(awkward, length=length, **options).collect()
    assert Counter((a, b, c, d, bytes(e)) for a, b, c, d, e in found) == Counter(cut_repeats(rows_of(awkward), length))


def test_suffixes_are_sorted():
    data = np.frombuffer(b"banana bandana banana nana" * 3, np.uint8)
    start = np.arange(len(data))
    order, shared = SuffixSorter(data, 0x9E3779B97F4A7C55).sort(start, len(data) - start, np.array([len(data)]))
    text = data.tobytes()
    assert order.tolist() == sorted(start, key=lambda i: text[i:])
    assert all(text[order[i] :][: shared[i]] == text[order[i - 1] :][: shared[i]] for i in range(1, len(order)))


def cut_substrings(rows, length):
    """Rows of one doc_id remove nothing from each other."""
    words = [((text or "").encode().split(), doc_id) for doc_id, text in rows]
    order = lambda one: (one is not None, one or 0)
    least = {}
    for own, doc_id in words:
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            least[window] = min(least.get(window, order(doc_id)), order(doc_id))
    for own, doc_id in words:
        gone, met = [False] * len(own), set()
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            if window in met or least[window] < order(doc_id):
                gone[i : i + length] = [True] * length
            met.add(window)
        yield doc_id, len(own), sum(gone), b" ".join(word for word, out in zip(own, gone) if not out).decode()


@pytest.mark.parametrize("length, options", [(20, {}), (6, {"gram": 2}), (6, {"gram": 2, "hot_kinds": 1})])
def test_substring_dedup(awkward, length, options):
    """A null doc_id is less than any other."""
    more = awkward.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("bigint"))
    docs = awkward.unionByName(more)
    found = substring_dedup.substring_report(docs, length=length, **options)
    got = Counter(tuple(row) for row in found.select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == Counter(cut_substrings(rows_of(docs), length))


def test_substring_of_a_document_without_id(spark):
    docs = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(40))), (5, " ".join(f"w{i}" for i in range(40)))], "doc_id bigint, text string")
    assert {row["doc_id"]: row["n_removed"] for row in substring_dedup.substring_report(docs).collect()} == {None: 0, 5: 40}


def test_empty_tables(empty):
    for report in (exact.duplicate_report, simhash.near_duplicate_report, suffix_dedup.repeat_report, substring_dedup.substring_report):
        assert report(empty).count() == 0
