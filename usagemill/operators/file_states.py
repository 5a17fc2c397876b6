"""Mergeable states of report files: what a file adds to counts, sums, sketches and null profiles.

A state is one row for each file (and date). It is worked out when the file is taken and never again: statistics over
any set of files or dates merge states and read no report. Counts, sums, maxima and the null profile are exact. Distinct
values and quartiles come from sketches, with the bounds below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.cells import cell, is_missing, present
from usagemill.operators.stats import DURATION

# Sketches of distinct values keep 2^12 registers. Their relative standard error is 1.04 / 64; three of these are the bound.
DISTINCT_LOG2 = 12
DISTINCT_BOUND = 3 * 1.04 / 2 ** (DISTINCT_LOG2 / 2)
# Sketches of quantiles; their rank error, in parts of the number of values, is at most this in 99 of 100 cases.
QUANTILE_K = 800
QUANTILE_BOUND = 2.446 / QUANTILE_K**0.9433

USAGE_SCHEMA = (
    "path string, date string, rows bigint, minutes_n bigint, minutes_sum double, minutes_max double, "
    "minutes_sketch binary, users_sketch binary, users_null boolean, applications_sketch binary, applications_null boolean"
)
PROFILE_SCHEMA = "path string, rows bigint, missing map<string,bigint>"
_SKETCHED = {"users": "UserId", "applications": "ApplicationName"}


def usage_state(clean: DataFrame, path: str, date: str) -> DataFrame:
    """States of clean rows by their file and date (``USAGE_SCHEMA``); both are names of columns.

    Columns that the report lacks leave their part empty.
    """
    minutes = cell(DURATION) if present(clean, [DURATION]) else F.lit(None).cast("double")
    parts = [
        F.count(F.lit(1)).alias("rows"),
        F.count(minutes).alias("minutes_n"),
        F.sum(minutes).alias("minutes_sum"),
        F.max(minutes).alias("minutes_max"),
        F.kll_sketch_agg_double(minutes, F.lit(QUANTILE_K)).alias("minutes_sketch"),
    ]
    for name, column in _SKETCHED.items():
        value = cell(column) if present(clean, [column]) else F.lit(None).cast("string")
        sketch = F.hll_sketch_agg(value, F.lit(DISTINCT_LOG2)) if present(clean, [column]) else F.lit(None).cast("binary")
        some_null = F.max(value.isNull()) if present(clean, [column]) else F.lit(None).cast("boolean")
        parts += [sketch.alias(f"{name}_sketch"), some_null.alias(f"{name}_null")]
    return clean.groupBy(cell(path).alias("path"), cell(date).cast("string").alias("date")).agg(*parts)


def profile_state(raw: DataFrame, path: str) -> DataFrame:
    """Rows and missing cells of each column by file (``PROFILE_SCHEMA``)."""
    fields = [field for field in raw.schema.fields if field.name != path]
    counts = [F.count_if(is_missing(cell(field.name), field.dataType)).alias(f"_{i}") for i, field in enumerate(fields)]
    found = raw.groupBy(cell(path).alias("path")).agg(F.count(F.lit(1)).alias("rows"), *counts)
    names = F.array(*[F.lit(field.name) for field in fields]).cast("array<string>")
    values = F.array(*[F.col(f"_{i}") for i in range(len(fields))]).cast("array<bigint>")
    return found.select("path", "rows", F.map_from_arrays(names, values).alias("missing"))


def _distinct(name: str) -> Column:
    """Estimated number of different values, NULL being one of them."""
    estimate = F.hll_sketch_estimate(F.hll_union_agg(f"{name}_sketch"))
    return F.coalesce(estimate, F.lit(0)) + F.coalesce(F.max(f"{name}_null").cast("bigint"), F.lit(0))


def merged_usage(states: DataFrame, *by: str) -> DataFrame:
    """``rows, avg_minutes, max_minutes, total_minutes, users, applications, q25, q50, q75`` of states, by some columns of them.

    Exact but for ``users`` and ``applications`` (off by ``DISTINCT_BOUND`` of the number) and the quartiles (off by
    ``QUANTILE_BOUND`` of the ranks). Empty averages, maxima and totals are 0, as in the statistics over rows.
    """
    sketch = F.kll_merge_agg_double("minutes_sketch")
    merged = states.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("minutes_sum") / F.nullif(F.sum("minutes_n"), F.lit(0)), F.lit(0.0)).alias("avg_minutes"),
        F.coalesce(F.max("minutes_max"), F.lit(0.0)).alias("max_minutes"),
        F.coalesce(F.sum("minutes_sum"), F.lit(0.0)).alias("total_minutes"),
        F.sum("minutes_n").alias("_n"),
        _distinct("users").alias("users"),
        _distinct("applications").alias("applications"),
        sketch.alias("_sketch"),
    )
    quartile = lambda share: F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(share)))
    names = [*by, "rows", "avg_minutes", "max_minutes", "total_minutes", "users", "applications"]
    return merged.select(*names, *[quartile(share).alias(f"q{int(100 * share)}") for share in (0.25, 0.5, 0.75)])


def merged_profile(states: DataFrame) -> DataFrame:
    """``column, null_pct`` over all files: a column that a file does not have is missing in all of its rows."""
    total = states.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
    cells = states.select("rows", F.explode("missing").alias("column", "missing"))
    # Rows of files that lack the column come from the total.
    known = cells.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    share = (F.col("missing") + F.col("total") - F.col("rows")) / F.nullif(F.col("total"), F.lit(0)) * F.lit(100)
    return known.join(F.broadcast(total)).select("column", F.coalesce(share, F.lit(0.0)).alias("null_pct"))


def merged_score(states: DataFrame) -> DataFrame:
    """``quality_score`` over all files: 100 less the mean percentage of missing cells, 100 without columns."""
    return merged_profile(states).agg((F.lit(100.0) - F.coalesce(F.avg("null_pct"), F.lit(0.0))).alias("quality_score"))
