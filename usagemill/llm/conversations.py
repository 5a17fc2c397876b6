"""Repair of conversations: faults, the cheapest edits that make turns alternate, and the repaired turns.

1. Rows are range-sorted by conversation and turn and cut into chunks of bounded rows and bytes, so that one
   conversation may be as long as it likes.
2. Turns that repeat an earlier one are found by a digest over all reducers.
3. Each chunk becomes a string of one byte a turn. Chunks are solved from a guess and fixed up until their cost vectors
   are those of the next chunk up to a constant (``viterbi.py``); only strings and vectors travel.
4. Each chunk says which state it leaves for each state it is entered in; a pass over these says where each is entered.
5. Chunks are traced on their own and meet their texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.llm import viterbi
from usagemill.llm.tables import SALTS, checkpointed, kept_table

CHUNK_ROWS, CHUNK_BYTES = 2048, 4 << 20
TURNS_AT_ONCE = 1 << 16  # turns whose edits a task holds as objects
# Fixed value: white space.
SPACE = " \t\n\v\f\r"
# Consecutive chunks that one task of the first fix-up pass takes; each further pass takes four times as many.
FIX_UP_CHUNKS = 64
# Fixed value: initials that may follow one another, su, ua and au.
LEGAL = {(0, 1), (1, 2), (2, 1)}
_ORDER = ("_role", "_text", "_hash", "_salt")


def turn_kind(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def turn_code(role: Column, text: Column) -> Column:
    """The byte of a turn that repeats no earlier one."""
    body = F.rtrim(text, F.lit(SPACE))
    broken = F.when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(4)
    return F.when(body == "", viterbi.BLANK).otherwise(turn_kind(role) + broken)


def _cut(payload: list[str]):
    """Numbers chunks and their rows; rows come sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, size, last = (TaskContext.get().partitionId() << 32) - 1, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("conv")
            new = [last is None or own[0].as_py() != last, *pc.not_equal(own[1:], own[:-1]).to_pylist()]
            last = own[batch.num_rows - 1].as_py()
            chunks, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
            for i, (first, length) in enumerate(zip(new, pc.binary_length(batch.column("text")).to_pylist())):
                if first or rows == CHUNK_ROWS or size + length > CHUNK_BYTES and rows:
                    chunk, rows, size = chunk + 1, 0, 0
                chunks[i], places[i] = chunk, rows
                rows, size = rows + 1, size + length
            yield pa.record_batch([pa.array(chunks), pa.array(places), *batch.select(payload).columns], names=["chunk", "at", *payload])

    return run


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """``chunk, at, conv, conv_id, turn, role, text, code``; chunks are numbered in the order of the rows."""
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text"))
    rows = turns.select(conv.alias("conv"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    # Rows of one turn stand by the first letters of role and text, then by a hash; rows that agree in all of this are equal
    # and their order is of no matter, so they may be dealt anyhow.
    rows = rows.select(
        "*",
        turn_code(F.col("role"), F.col("text")).cast("int").alias("code"),
        F.substring("role", 1, 32).alias("_role"),
        F.substring("text", 1, 64).alias("_text"),
        F.xxhash64("role", "text").alias("_hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), *_ORDER]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    payload = ["conv", "conv_id", "turn", "role", "text", "code"]
    shape = ", ".join(f"{name} {kind}" for name, kind in rows.select(*payload).dtypes)
    return kept_table(dealt.select(*payload).mapInArrow(_cut(payload), f"chunk bigint, at int, {shape}"), "turns")


def _repeats(rows: DataFrame) -> DataFrame:
    """``chunk, at`` of turns whose role and text were seen earlier in their conversation."""
    digest = F.sha2(F.concat_ws(":", F.col("conv"), F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256)
    keys = rows.select(digest.alias("digest"), F.length("conv").alias("size"), F.struct("chunk", "at").alias("place"))
    first = keys.groupBy("digest", "size").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Adaptive execution splits a turn that very many rows repeat.
    return keys.join(first, ["digest", "size"]).filter(F.col("place") != F.col("first")).select("place.*")


def _strings(rows: DataFrame) -> DataFrame:
    """``conv, conv_id, chunk, codes, kinds``: a byte for each turn, and one for the initial of its role."""
    own = rows.select("conv", "conv_id", "chunk", F.struct("at", "code", turn_kind(F.col("role")).alias("kind")).alias("turn"), F.lit(None).cast("int").alias("again"))
    no = [F.lit(None).cast(kind).alias(name) for name, kind in own.select("conv", "conv_id").dtypes]
    again = _repeats(rows).select(*no, "chunk", F.lit(None).cast(own.schema["turn"].dataType).alias("turn"), F.col("at").alias("again"))
    found = own.unionByName(again).groupBy("chunk").agg(
        F.max("conv").alias("conv"),
        F.max("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list("turn")).alias("turns"),
        F.collect_list("again").alias("again"),
    )
    # A blank turn stays blank.
    code = lambda turn: F.when((turn["code"] < viterbi.BLANK) & F.array_contains("again", turn["at"]), viterbi.DUPLICATE).otherwise(turn["code"])
    as_bytes = lambda value: F.unhex(F.array_join(F.transform("turns", lambda turn: F.lpad(F.hex(value(turn)), 2, "0")), ""))
    return found.select("conv", "conv_id", "chunk", as_bytes(code).alias("codes"), as_bytes(lambda turn: turn["kind"]).alias("kinds"))


def _as_text(vector: viterbi.Vector) -> str:
    return " ".join(map(str, vector))


def _as_vector(text: str) -> viterbi.Vector:
    return tuple(map(int, text.split()))


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _kind(name: str) -> pa.DataType:
    return pa.list_(_kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]


def _few(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """The rows of a batch, so many at once as have about TURNS_AT_ONCE turns in their ``codes``."""
    ends = np.cumsum(pc.binary_length(batch.column("codes")).to_numpy(zero_copy_only=False) + 16) // TURNS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start).to_pylist()


def _mapped(df: DataFrame, one: Callable[[dict], dict], shape: str) -> DataFrame:
    """``df``, which has ``codes``, with each row replaced by what ``one`` makes of it."""
    kinds = {name: _kind(kind) for name, kind in (part.split() for part in shape.split(", "))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _few(batch):
                out = [one(row) for row in rows]
                yield pa.record_batch([pa.array([row[name] for row in out], kind) for name, kind in kinds.items()], names=list(kinds))

    return df.mapInArrow(run, shape)


def _fixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the chunks of a group from the last one; each takes over what the one behind it has now."""
    group, vector = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["conv"], row["grp"]) != group:
                group, vector = (row["conv"], row["grp"]), _as_vector(row["wanted"])
            behind, before = _as_vector(row["behind"]), _as_vector(row["before"])
            vector, behind = viterbi.fix_up(row["codes"], behind, vector, before), vector
            out.append((row["conv"], row["chunk"], row["seq"], row["codes"], _as_text(behind), _as_text(vector)))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            names = ["conv", "chunk", "seq", "codes", "behind", "before"]
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names=names)


def _stitched(chunks: DataFrame, fix_up_chunks: int) -> DataFrame:
    """``conv, chunk, seq, codes, behind, before`` of the chunks of conversations that have several, with true vectors."""
    order = Window.partitionBy("conv").orderBy("chunk")
    shape = "conv string, chunk bigint, codes binary, behind string, before string"

    def guessed(row: dict) -> dict:
        before = viterbi.solve(row["codes"], viterbi.GUESS)
        return row | {"behind": _as_text(viterbi.GUESS), "before": _as_text(before)}

    solved = checkpointed(_mapped(chunks.select("conv", "chunk", "codes"), guessed, shape).withColumn("seq", F.row_number().over(order).cast("bigint") - 1))
    size = fix_up_chunks
    while True:
        wanted = F.coalesce(F.lead("before").over(order), F.lit(_as_text(viterbi.END)))
        open_ = checkpointed(solved.select("conv", "chunk", "behind", wanted.alias("wanted")))
        if open_.filter("behind <> wanted").isEmpty():
            return solved
        rows = solved.join(open_.select("chunk", "wanted"), "chunk").withColumn("grp", F.expr(f"seq div {size}"))
        dealt = rows.repartition("conv", "grp").sortWithinPartitions("conv", "grp", F.desc("seq"))
        solved = checkpointed(dealt.mapInArrow(_fixed, "conv string, chunk bigint, seq bigint, codes binary, behind string, before string"))
        size *= 4


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered; chunks come in order, with the state they leave for each one."""
    conv, state = None, viterbi.NOTHING
    for batch in batches:
        chunks, states = [], []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                conv, state = row["conv"], viterbi.NOTHING
            chunks.append(row["chunk"])
            states.append(state)
            state = row["exits"][state]
        yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(states, pa.int32())], names=["chunk", "state"])


def _traced(row: dict) -> dict:
    """The edits of a chunk and what they sum to."""
    codes, kinds = row["codes"], row["kinds"]
    edits, state = viterbi.trace(codes, _as_vector(row["behind"]), row["state"])
    closing = viterbi.ending(state) if row["last"] else []
    pairs = zip([row["earlier"]] if row["earlier"] is not None else [], kinds[:1])
    return {
        "chunk": row["chunk"],
        "audit": "".join(edit.letters for edit in edits) + "I" * len(closing),
        "cost": sum(edit.cost for edit in edits) + viterbi.INSERT * len(closing),
        "blank": codes.count(viterbi.BLANK),
        "duplicate": codes.count(viterbi.DUPLICATE),
        "truncated": sum(4 <= code < 8 for code in codes),
        "illegal": sum(pair not in LEGAL for pair in [*pairs, *zip(kinds, kinds[1:])]),
        "puts": [list(edit.puts) for edit in edits],
        "roles": [edit.role for edit in edits],
        "stays": [edit.stays for edit in edits],
        "closing": closing,
    }


_TRACED = (
    "chunk bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "puts array<array<string>>, roles array<string>, stays array<boolean>, closing array<string>"
)


def repaired_pieces(turns: DataFrame, fix_up_chunks: int = FIX_UP_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """The sorted turns, and of each chunk of them: ``conv, conv_id, chunk, alone, audit, cost, blank, duplicate, truncated,
    illegal, piece, lines``.

    ``piece`` is the repaired text of the chunk, a line ``role:text`` for each of its ``lines`` turns.
    """
    rows = _sorted_rows(turns)
    chunks = kept_table(_strings(rows), "chunks")
    order = Window.partitionBy("conv").orderBy("chunk")
    own_kind = F.expr("conv(hex(substring(kinds, -1, 1)), 16, 10)").cast("int")
    placed = checkpointed(
        chunks.select(
            "conv", "chunk", F.lag(own_kind).over(order).alias("earlier"), F.lead("chunk").over(order).isNull().alias("last"), F.lag("chunk").over(order).isNull().alias("first")
        ).select("chunk", "earlier", "last", (F.col("first") & F.col("last")).alias("alone"))
    )
    several = chunks.join(placed.filter("NOT alone").select("chunk"), "chunk")
    solved = _stitched(several, fix_up_chunks)
    leaves = _mapped(
        solved.select("conv", "chunk", "codes", "behind"),
        lambda row: {"conv": row["conv"], "chunk": row["chunk"], "exits": viterbi.exits(row["codes"], _as_vector(row["behind"]))},
        "conv string, chunk bigint, exits array<bigint>",
    )
    entered = leaves.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_entered, "chunk bigint, state int")
    stitched = solved.select("chunk", "behind").join(entered, "chunk")
    ready = chunks.join(placed, "chunk").join(stitched, "chunk", "left").select(
        "chunk", "codes", "kinds", "earlier", "last",
        F.coalesce("behind", F.lit(_as_text(viterbi.END))).alias("behind"),
        F.coalesce("state", F.lit(viterbi.NOTHING)).alias("state"),
    )
    traced = _mapped(ready, _traced, _TRACED)

    gathered = rows.groupBy("chunk").agg(
        F.max("conv").alias("conv"), F.max("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns")
    )
    met = gathered.join(traced, "chunk").join(placed.select("chunk", "alone"), "chunk")

    def own(turn: Column, i: Column) -> Column:
        line = F.concat_ws(":", F.coalesce(F.get("roles", i), turn["role"]), turn["text"])
        return F.concat(_put("puts", i), F.when(F.get("stays", i), F.array(line)).otherwise(F.array().cast("array<string>")))

    lines = F.concat(F.flatten(F.transform("turns", own)), F.transform("closing", lambda role: F.concat(role, F.lit(":"))))
    pieces = met.withColumn("_lines", lines).select(
        "conv", "conv_id", "chunk", "alone", "audit", "cost", "blank", "duplicate", "truncated", "illegal",
        F.array_join("_lines", "\n").alias("piece"), F.size("_lines").alias("lines"),
    )
    return rows, kept_table(pieces, "pieces")


def _put(name: str, i: Column) -> Column:
    return F.transform(F.get(name, i), lambda role: F.concat(role, F.lit(":")))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, one piece held at a time; they come in order."""
    conv, digest, any_ = None, None, False

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "long_sha256"])

    for batch in batches:
        for own, lines, piece in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist(), batch.column("piece").cast(pa.binary())):
            if own != conv:
                if conv is not None:
                    yield done()
                conv, digest, any_ = own, hashlib.sha256(), False
            if lines:
                digest.update(b"\n" if any_ else b"")
                digest.update(piece.as_buffer())
                any_ = True
    if conv is not None:
        yield done()


def repair_report(turns: DataFrame, **options) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation in ``turns``.

    ``turns`` has ``conv_id, turn, role, text``; a null role or text is one space, a null conv_id is a conversation of its own,
    null turns come first. Rows of one turn stand by their first letters and a hash; equal rows repeat one another. Of the
    faults of a row the first counts: blank, a duplicate of an earlier row's role and text, truncated (the last letter
    that is no white space is none of ``.!?``). ``illegal`` counts neighbours whose initials are not su, ua or au. ``audit`` is
    the least string of cheapest edits (Keep, Rerole, Delete, Insert) that leave initials ``(s?(ua)+)?``. A conversation and a
    text may be of any length; other columns of ``turns`` may have any name. An empty table gives no row.
    """
    rows, pieces = repaired_pieces(turns, **options)
    gaps = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda part: part["audit"]), "")
    whole = F.when(F.col("alone"), F.sha2(F.col("piece").cast("binary"), 256))
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    sums = pieces.groupBy("conv").agg(
        F.max("conv_id").alias("conv_id"), *[F.sum(name).alias(name) for name in names], audit.alias("audit"), F.max(whole).alias("whole")
    )
    parts = pieces.filter("NOT alone").select("conv", "chunk", "piece", "lines")
    long = parts.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_hashed, "conv string, long_sha256 string")
    out = sums.join(gaps, "conv").join(long, "conv", "left")
    return out.select("conv_id", "gaps", *names, "audit", F.coalesce("whole", "long_sha256").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the CRC-32 of ``conv_id:turn``: of 20 remainders 0 drops the row, 1 empties
    its text, 2 strikes out its sentence marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    name, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fault = F.crc32(F.concat(name, F.lit(":"), turn).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    rows = rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def damage_report(turns: DataFrame, **options) -> DataFrame:
    """``repair_report`` of the damaged ``turns``, with a row for every conversation that they had; one that lost all of its
    rows has zeros, an empty audit and the digest of an empty text."""
    found = repair_report(damaged(turns), **options).withColumnRenamed("conv_id", "_id")
    ids = turns.select("conv_id").distinct()
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
