"""Metric samples as text: one line ``name{label="value",...} value timestamp`` per sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_label(value: Column) -> Column:
    """Backslash first, then the quote and the line break that are written with one."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def label_text(labels: Column) -> Column:
    """``k="v",...`` in the order of the map."""
    pairs = F.transform(
        F.map_entries(labels),
        lambda pair: F.concat(pair["key"], F.lit('="'), escape_label(pair["value"]), F.lit('"')),
    )
    return F.array_join(pairs, ",")


def number_text(value: Column) -> Column:
    """Plain decimal digits from 1e-4 up to 1e16, with ``.0`` on whole numbers; Spark's own text outside."""
    size = F.abs(value)
    text = value.cast("string")
    whole = (value == F.floor(value)) & (size < F.lit(1e16))
    scientific = ((size >= F.lit(1e7)) & (size < F.lit(1e16))) | ((size >= F.lit(1e-4)) & (size < F.lit(1e-3)))
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    return (
        F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0")))
        .when(scientific, plain)
        .otherwise(text)
    )


def sample_line(name: Column, labels: Column, value: Column, timestamp_ms: Column) -> Column:
    braces = F.when(F.size(labels) > 0, F.concat(F.lit("{"), label_text(labels), F.lit("}"))).otherwise("")
    return F.concat(name, braces, F.lit(" "), number_text(value), F.lit(" "), timestamp_ms.cast("string"))
