"""SimHash near-dedup: fingerprints of word shingles, linked through a Gray-order hierarchical index.

Four blocks of 16 bits: two fingerprints within three bits agree on a block at least. Each distinct fingerprint goes,
once per block, to the reducer of the block's value, where a tree over those fingerprints finds the links. Only links
that join two components there are sent on, so a group of n copies gives n - 1 links at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.components import components
from usagemill.llm.gray_index import gray_rank, group_links
from usagemill.llm.repeats import member_filter
from usagemill.llm.tables import byte_chunks, checkpointed, own_rows, salted_lookup

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
BITS = 64
SLICE = 1 << 16  # hashes of a text that are counted at once
# A reducer joins whole groups into one forest of about so many fingerprints.
FOREST = 1 << 18
# A block value that more fingerprints share is split by the rest of the bits, down to SPLITS times.
HOT_GROUP = 1 << 16
SPLITS = 2


def _fingerprint(text: bytes, words_per: int) -> int:
    words = text.lower().split()  # bytes: lower-cases A-Z alone, splits at space and \t to \r
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - words_per + 1]
    ends, digest = ends[words_per - 1 :], xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(starts), SLICE):
        part = slice(first, first + SLICE)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprint_batches(words_per: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_fingerprint(text, words_per) for _, texts in byte_chunks(batch, "text", SLICE) for text in texts]
            signed = np.array(codes, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("row"), pa.array(signed)], names=["row", "code"])

    return run


def fingerprints(docs: DataFrame, carry: list[str], words_per: int = SHINGLE_WORDS) -> DataFrame:
    """``row`` (a struct of the carried columns) and the 64-bit ``code`` of every row of ``docs``."""
    rows, kind = own_rows(docs, carry)
    return rows.mapInArrow(_fingerprint_batches(words_per), f"row {kind}, code bigint")


def _piece(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, BITS - first - width).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(code: str, first: int, width: int, parts: int) -> Column:
    """``parts`` consecutive blocks of bits, as an array of (block, value); blocks differ by a bit in width at most."""
    cuts = [first + width * i // parts for i in range(parts + 1)]
    return F.array(
        *[F.struct(F.lit(a).alias("first"), _piece(F.col(code), a, b - a).alias("value")) for a, b in zip(cuts, cuts[1:])]
    )


def _forests(limit: int):
    """Links of one partition; rows come sorted by group, one group or several make a forest."""

    def solve(codes: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(codes), groups))
        codes, groups = codes[order], groups[order]
        first = group_links(codes, groups, limit)
        linked = np.flatnonzero(first != np.arange(len(codes)))
        signed = codes.view(np.int64)
        return pa.record_batch([pa.array(signed[first[linked]]), pa.array(signed[linked])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, groups = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            codes = np.concatenate([codes, batch.column("code").to_numpy().view(np.uint64)])
            groups = np.concatenate([groups, batch.column("group").to_numpy()])
            if len(codes) >= FOREST and groups[0] != groups[-1]:
                whole = int(np.searchsorted(groups, groups[-1]))
                yield solve(codes[:whole], groups[:whole])
                codes, groups = codes[whole:], groups[whole:]
        if len(codes):
            yield solve(codes, groups)

    return run


def _keyed(codes: DataFrame, parts: int) -> DataFrame:
    """Each code once per block, with the ``group`` of codes that share the block's value."""
    each = codes.select("code", F.explode(_blocks("code", 0, BITS, parts)).alias("at"))
    return each.select("code", F.xxhash64("at.first", "at.value").alias("group"))


def links(codes: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """Links ``a, b`` that join all distinct ``code`` values within ``limit`` bits, directly or through others.

    A group over HOT_GROUP codes is dealt anew: codes within the limit agree on one of ``limit + 1`` parts of other
    cuts as well, so each code goes to the groups of the pairs (its hot value, its value of a finer part).
    """
    if not 0 <= limit < BITS:
        raise ValueError("the distance must be from 0 to 63 bits")
    keyed = _keyed(codes, limit + 1)
    for turn in range(SPLITS):
        sizes = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_GROUP)
        sizes = checkpointed(sizes)
        if sizes.isEmpty():
            break
        hot = keyed.join(sizes.select("group"), "group", "left_semi")
        cold = keyed.join(sizes.select("group"), "group", "left_anti")
        # Cuts that start elsewhere: parts of the code turned by some bits.
        shift = 5 + 6 * turn
        turned = F.shiftleft("code", shift).bitwiseOR(F.shiftrightunsigned("code", BITS - shift))
        finer = hot.withColumn("turned", turned).select(
            "code", "group", F.explode(_blocks("turned", 0, BITS, limit + 1)).alias("at")
        )
        keyed = cold.select("code", "group").unionByName(
            finer.select("code", F.xxhash64("group", "at.first", "at.value", F.lit(turn)).alias("group"))
        )
    grouped = keyed.repartition("group").sortWithinPartitions("group")
    return grouped.mapInArrow(_forests(limit), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, carry: list[str], words_per: int = SHINGLE_WORDS, limit: int = MAX_DISTANCE
) -> DataFrame:
    """``row`` (a struct of the carried columns), ``fingerprint`` and ``component_id`` of every row of ``docs``.

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; shingles keep repeats. A text
    of fewer words is one shingle; a null text, or one without a word, has the fingerprint zero and links like any
    other. ``component_id`` is the smallest doc_id that can be reached; rows that share a text or a doc_id are told
    apart by nothing else. Null doc_ids count only where a component has no other. Columns of ``docs`` may have any
    name; an empty table gives no row.
    """
    own = docs.select(F.struct(*[F.col(f"`{name}`") for name in carry]).alias("r"), "doc_id", "text")
    marked = checkpointed(
        fingerprints(own.select("r", "doc_id", "text"), ["r", "doc_id"], words_per).select(
            F.col("row.r").alias("row"), F.col("row.doc_id").alias("_id"), "code"
        )
    )
    distinct = checkpointed(marked.groupBy("code").agg(F.min("_id").alias("least")))
    joined = components(links(distinct.select("code"), limit))
    rooted = distinct.join(joined, distinct["code"] == joined["node"], "left").select(
        "code", "least", F.coalesce("root", "code").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = salted_lookup(rooted.select("code", "root"), "root", smallest, F.col("code")).select("code", "component_id")
    found = salted_lookup(marked, "code", lookup, F.coalesce(F.col("_id").cast("string"), F.lit("")))
    return found.select("row", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id", "_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return near_duplicates(docs, ["doc_id"]).select("row.doc_id", "fingerprint", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one row, of its smallest doc_id.

    Of several texts under that doc_id the one of the smallest hash stays, of rows that share it the one of the
    smallest hash of all columns. Rows of components without any doc_id are dropped only if they have the text of
    another one. Only ids and hashes of texts are shuffled, and the rows whose id may be one of those that go or repeat.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    found = near_duplicates(own, ["doc_id", "hash"]).select("row.doc_id", "row.hash", "component_id")
    found = checkpointed(found.groupBy("doc_id", "hash", "component_id").agg(F.count(F.lit(1)).alias("n")))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    least = found.filter(first & F.col("doc_id").isNotNull()).groupBy("component_id").agg(F.min("hash").alias("least"))
    stays = first & (F.col("least").isNull() | (F.col("hash") == F.col("least")))
    judged = found.join(least, "component_id", "left").select("doc_id", "hash", "n", stays.alias("stays"))
    special = checkpointed(judged.filter("NOT stays OR n > 1").select("doc_id", "hash", "stays"))
    members = member_filter(special.select(F.xxhash64("doc_id", "hash").alias("key")))
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("hash")
    )
    flagged = rows.withColumn("_maybe", members.column(F.xxhash64("doc_id", "hash")))
    maybe, marked = flagged.filter("_maybe").alias("m"), special.alias("s")
    same = F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("m.hash") == F.col("s.hash"))
    untouched = maybe.join(marked, same, "left_anti").select("row.*")
    repeated = maybe.join(marked.filter("stays"), same).groupBy("m.doc_id", "m.hash")
    one = repeated.agg(F.min_by("m.row", F.xxhash64(F.to_json("m.row"))).alias("row")).select("row.*")
    return flagged.filter("NOT _maybe").select("row.*").unionByName(untouched).unionByName(one)
