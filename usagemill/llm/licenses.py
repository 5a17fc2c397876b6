"""License scans: every run of whole lines of a text, in a canonical form, meets the known licences by a join on digests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.tables import kept_table

# Notices by name. Whole licences and longer notices are the files of TEXTS, named by licence and, after
# a ``~``, by what sets the text apart from others of that licence.
KNOWN = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Released under the MIT License."),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
TEXTS = Path(__file__).with_name("license_texts")
# Spellings and what they are read as, in this order.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("&", " and ")]
# Copyright lines, but not lines on which a sentence of a licence goes on, however the licence is wrapped.
COPYRIGHT = (
    r"(^|\n)[ \t]*(copyright(?!ed|able|[ \t]+(notices?|holders?|owners?|laws?|licenses?|permissions?|statements?|interests?|disclaimers?"
    r"|protection|treaty|status|and|or|on|in|is|to|as|for|of|over|if)\b)"
    r"|\(c\)(?![ \t]+(you|the|a|an|any|all|if|in|to|under|it|is|this|that|for|as|by|or|no|such|each|affirmer|representations)\b)"
    r"|©|all rights reserved)[^\n]*"
)
# Rows of keys, hashes and hits, of some 100 bytes each, up to which such a table is broadcast.
BROADCAST_ROWS = 1 << 17
ANCHOR = 12  # a run of lines is looked at if it begins with the first so many words of a known text


def canonical_lines(text: Column) -> Column:
    """A text with A-Z lower-cased, without copyright lines, in one spelling: its lines, each of words of a-z and 0-9 a
    space apart, without empty ones."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    for spelling, form in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(form))
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    return F.trim(out, F.lit(" \n"))


def canonical(text: Column) -> Column:
    """The words of ``canonical_lines``, a space apart."""
    return F.translate(canonical_lines(text), "\n", " ")


def known_licenses(spark: SparkSession) -> DataFrame:
    files = [(path.stem.split("~")[0], path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(KNOWN + files, "license string, text string")


# The line break before each line, with the first words from there on, across lines.
_BEGINS = "\n(?=((?:[a-z0-9]+[ \n]){1,%d}))" % ANCHOR


def _begins(lined: Column) -> Column:
    """For each line of a canonical text the first ANCHOR words from there on, a space apart."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), lined, F.lit("\n")), F.lit(_BEGINS), F.lit(1))
    return F.transform(found, lambda words: F.rtrim(F.translate(words, "\n", " ")))


def known_forms(known: DataFrame) -> DataFrame:
    """``license, digest, size, words, anchor`` of the different canonical forms of known texts: their digest, length, and the
    hash of their first ``words`` words."""
    forms = known.select("license", canonical(F.col("text").cast("string")).alias("form")).filter("form != '' AND license IS NOT NULL")
    one = forms.groupBy("form").agg(F.min("license").alias("license"))
    sized = one.withColumn("words", F.least(F.size(F.split("form", " ")), F.lit(ANCHOR)))
    digest = F.sha2(F.col("form").cast("binary"), 256).alias("digest")
    return sized.select("license", digest, F.length("form").alias("size"), "words", F.xxhash64(F.expr("substring_index(form, ' ', words)")).alias("anchor"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows of bounded size; else Spark shuffles or splits as it likes."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _hashes(words: Column, sizes: list[int]) -> Column:
    return F.array(*[F.xxhash64(F.substring_index(words, " ", size)) for size in sizes])


def _hits(docs: DataFrame, looked: DataFrame, forms: DataFrame, sizes: list[int]) -> DataFrame:
    """``key, found``: of each different text with hits the lengths (less than 0) and names of the known texts in it.

    Hashes of the beginnings of lines meet those of the known texts by a join, so that only texts with a line that begins
    like a known one go on; the digest of each run of lines from there meets the digests of the known texts.
    """
    text = F.col("text").cast("string")
    each = looked.select("key", F.explode("anchors").alias("anchor"))
    begun = each.join(_small(kept_table(forms.select("anchor").distinct(), "anchors")), "anchor", "left_semi")
    keys = _small(kept_table(begun.select("key").distinct(), "licensed"))
    # Copies of a text are one text here; tasks send one of them.
    some = docs.select(_key(), text.alias("text")).join(keys, "key").groupBy("key").agg(F.first("text").alias("text"))
    lines = some.select("key", canonical_lines(F.col("text")).alias("lined"))
    starts = lines.select("key", F.split("lined", "\n").alias("lines"), F.posexplode(_begins(F.col("lined"))).alias("line", "words"))
    each = starts.select("key", "lines", "line", F.explode(F.array_distinct(_hashes(F.col("words"), sizes))).alias("anchor"))
    met = each.join(forms, "anchor")
    # A run of ``size`` letters has at most as many lines.
    rest = met.withColumn("run", F.concat(F.array_join(F.slice("lines", F.col("line") + 1, F.col("size") + 1), "\n"), F.lit("\n")))
    own = F.sha2(F.translate(F.substring("run", F.lit(1), F.col("size")), "\n", " ").cast("binary"), 256)
    ends = F.substring("run", F.col("size") + 1, F.lit(1)) == "\n"
    hits = rest.select("key", "size", "license", "digest", own.alias("own"), ends.alias("ends")).filter("ends AND own = digest")
    return hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct((-F.col("size")).alias("order"), F.col("license").alias("name")))).alias("found"))


def _key() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")), 256).alias("key")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, license, licenses, canonical_sha256`` of every row.

    ``licenses`` has the names of the known texts that are, in canonical form, a run of whole lines of the text: a line,
    a paragraph, a block at its end or anywhere, or all of it, however it is wrapped. ``license`` is the name of the
    longest of them, the smallest name of equal lengths; null where there is none. ``canonical_sha256`` is of the whole
    text. A null text is an empty one and matches nothing, nor does an empty known text. Of known texts with one
    canonical form the smallest name stands. Texts and known texts may be of any length, and ``known`` a table of any size.
    Rows that repeat have the same result; other columns do not matter; an empty table gives no row.
    """
    # As written tables their sizes are known: Spark broadcasts small ones at once, and shuffles no text for them.
    forms = kept_table(known_forms(known), "licenses")
    sizes = sorted(row["words"] for row in forms.select("words").distinct().collect())  # at most ANCHOR numbers
    whole = F.sha2(canonical(F.col("text").cast("string")).cast("binary"), 256).alias("canonical_sha256")
    if not sizes:
        return docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.array().cast("array<string>").alias("licenses"), whole)
    # Each text is brought into canonical form once; what is kept of it are hashes.
    lined = docs.select("doc_id", _key(), canonical_lines(F.col("text").cast("string")).alias("lined"))
    anchors = F.array_distinct(F.flatten(F.transform(_begins(F.col("lined")), lambda words: _hashes(words, sizes))))
    digest = F.sha2(F.translate("lined", "\n", " ").cast("binary"), 256).alias("canonical_sha256")
    looked = kept_table(lined.select("doc_id", "key", digest, anchors.alias("anchors")), "begins")
    hits = _small(kept_table(_hits(docs, looked.select("key", "anchors"), forms, sizes), "hits"))
    # Adaptive execution splits a text that very many rows share.
    met = looked.select("doc_id", "key", "canonical_sha256").join(hits, "key", "left")
    names = F.coalesce(F.sort_array(F.array_distinct("found.name")), F.array().cast("array<string>")).alias("licenses")
    return met.select("doc_id", F.get("found.name", F.lit(0)).alias("license"), names, "canonical_sha256")
