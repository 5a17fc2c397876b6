"""Exact dedup: a Bloom pass finds hashes that may repeat; only rows with such a hash are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.repeats import cells_log2, repeat_filter
from usagemill.llm.tables import salted_lookup

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")), 256)


def _key(digest: Column) -> Column:
    """The first 60 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _marked(docs: DataFrame, carry: Sequence[str], log2: int | None) -> DataFrame:
    """``row``, the columns of ``RESULT`` and ``_rows``: how many rows have the text and doc_id that stay."""
    hashed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"), F.col("doc_id").alias("_id"), _digest().alias("text_sha256")
    )
    seen = repeat_filter(docs.select(_key(_digest()).alias("key")), log2 or cells_log2(docs.count()))
    flagged = hashed.withColumn("_maybe", seen.column(_key(F.col("text_sha256"))))
    one = F.lit(1).cast("bigint")
    alone = flagged.filter(~F.col("_maybe")).select(
        "row", F.col("_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256", one.alias("_rows")
    )
    maybe = flagged.filter("_maybe").drop("_maybe")
    each = maybe.groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("_id").isNotNull().alias("has"), "_id", "n")).alias("best")
    groups = each.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), best)
    groups = groups.select("text_sha256", F.col("best._id").alias("keep_id"), "group_size", F.col("best.n").alias("_rows"))
    spread = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    met = salted_lookup(maybe, "text_sha256", groups, spread).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    return alone.unionByName(met.select("row", *RESULT, "_rows"))


def mark_duplicates(docs: DataFrame, carry: Sequence[str] = ("doc_id",), log2: int | None = None) -> DataFrame:
    """Every row, dropped ones too: the struct ``row`` of the carried columns, ``keep_id, group_size, kept,
    text_sha256``.

    ``docs`` has ``doc_id`` and ``text``; other columns may have any name. Texts are equal if their UTF-8 bytes are, of
    any length; null counts as empty. The largest doc_id of equal texts stays. Rows of one doc_id and text are one
    document and stand or fall together; a row without a doc_id stays only if no equal text has one. An empty table
    gives no row. Rows whose hash occurs once by the filter pass straight through; the rest are counted by digest in
    each task before the shuffle, and a digest that many rows share is dealt over many reducers.
    """
    return _marked(docs, carry, log2).drop("_rows")


def exact_dedup(docs: DataFrame, log2: int | None = None) -> DataFrame:
    """One row for each text, with all its columns: of the rows of the doc_id that stays the one of the smallest hash.

    Only rows that repeat with text and doc_id are gathered for that, in each task before the shuffle.
    """
    kept = _marked(docs, docs.columns, log2).filter("kept")
    least = F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
    several = kept.filter("_rows > 1").groupBy("text_sha256").agg(least)
    return kept.filter("_rows = 1").select("row.*").unionByName(several.select("row.*"))


def duplicate_report(docs: DataFrame, log2: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    return mark_duplicates(docs, ("doc_id",), log2).select("row.doc_id", *RESULT)
