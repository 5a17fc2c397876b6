"""Repair of conversations against plain code that tries all edits in order of cost."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from usagemill.llm import conversations, viterbi

SPACE = re.compile("[\x20\x09-\x0d]")
SHAPE = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dijkstra over (cost, letters): the least letters of least cost, and the lines."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, last, lines = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, letters, "\n".join(lines)

        def put(more, letter, step, role, line):
            now = last if line is None else role[:1]
            if line is not None and now not in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                return
            heapq.heappush(heap, (cost + more, letters + letter, at + step, now, lines if line is None else (*lines, line)))

        for role in ("user", "assistant"):
            put(2, "I", 0, role, f"{role}:")
        if at < len(rows):
            role, text = rows[at][2:]
            put(3, "D", 1, "", None)
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    put(extra, "K", 1, role, f"{role}:{text}")
                for other in ("user", "assistant"):
                    put(2 + extra, "R", 1, other, f"{other}:{text}")


def plain(rows, hurt=True):
    groups, out = defaultdict(list), {}
    for row in damage(rows) if hurt else rows:
        groups[row[0]].append(row)
    for conv in {row[0] for row in rows}:
        own = sorted(groups[conv], key=lambda row: (row[1] is not None, row[1] or 0))
        faults, seen = [], set()
        for _, _, role, text in own:
            body = SPACE.sub("", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, lines = cheapest(own, faults)
        turns = {row[1] for row in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def found(report):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = report.collect()
    out = {row["conv_id"]: tuple(row[name] for name in names) for row in rows}
    assert len(out) == len(rows)
    return out


def draw(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No", "", " \t", "Why? ", "A long answer\nof two lines!", "so"]
    turns = sorted(rng.choices([*range(2 * n), None] if n > 3 else range(9), k=n), key=lambda t: (t is not None, t or 0))
    # Rows of one turn have no order of their own, so each turn has one.
    return [(conv, turn, rng.choice(roles), f"{rng.choice(texts)}") for turn in sorted({*turns}, key=lambda t: (t is not None, t or 0))]


def test_given_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(conversations.damage_report(turns)) == plain([tuple(row) for row in turns.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("rows", [2048, 1, 3])
def test_random_conversations(spark, monkeypatch, rows):
    """Also with chunks of one row or three, so that all conversations are stitched."""
    monkeypatch.setattr(conversations, "CHUNK_ROWS", rows)
    rng = random.Random(rows)
    data = [row for conv in [None, *range(60)] for row in draw(rng, conv, rng.randrange(1, 14))]
    rng.shuffle(data)
    turns = spark.createDataFrame(data, SHAPE).withColumns({"chunk": F.lit(1), "codes": F.lit("x"), "conv": F.lit(0)}).repartition(4)
    assert found(conversations.repair_report(turns, fix_up_chunks=2)) == plain([(c, t, r, x) for c, t, r, x in data], hurt=False)


def test_damage_of_awkward_rows(spark):
    rng = random.Random(8)
    data = [row for conv in [None, *range(40)] for row in draw(rng, conv, rng.randrange(1, 9))]
    data += [(700, None, None, None), (701, 5, "user", None), (702, 1, None, "Hm."), (703, 1, "user", "word " * 50_000 + "end.")]
    assert found(conversations.damage_report(spark.createDataFrame(data, SHAPE))) == plain(data)
    assert found(conversations.damage_report(spark.createDataFrame([], SHAPE))) == {}


def test_one_long_conversation(spark, monkeypatch):
    """Chunks whose vectors never meet (unknown roles only) and turns that all repeat: many passes, the same result."""
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 5)
    for role in (lambda i: "tool", lambda i: "user" if i % 7 else "assistant", lambda i: "system"):
        data = [(1, i, role(i), f"{i % 40}." if i % 3 else f"{i}") for i in range(101)]
        assert found(conversations.repair_report(spark.createDataFrame(data, SHAPE), fix_up_chunks=1)) == plain(data, hurt=False)


def test_repeated_rows(spark):
    """Equal rows are duplicates of one another, wherever they are dealt."""
    data = [(1, None, "user", "Same.")] * 50 + [(1, 2, "assistant", "Yes.")] * 3
    got = found(conversations.repair_report(spark.createDataFrame(data, SHAPE).repartition(7)))
    assert got == plain(data, hurt=False)


def test_fix_up_ends_where_vectors_meet():
    codes = bytes(random.Random(2).choices([0, 1, 2, 5, 6, 8, 9], k=400))
    true = viterbi.solve(codes, viterbi.END)
    for other in [(0, 4, 0, 2), (2, 2, 0, 2), (0, 2, 1, 0)]:
        assert viterbi.fix_up(codes, other, viterbi.END, viterbi.solve(codes, other)) == true
