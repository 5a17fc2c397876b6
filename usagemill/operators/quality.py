"""Null profile: the share of missing cells per column and one score per table.

The whole profile is a single aggregate over the table, however many columns it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.cells import cell, is_missing

ROWS = "rows"


def missing_counts(df: DataFrame) -> list[Column]:
    """Aggregates: the row count, then one count of missing cells per column, named by position."""
    counts = [F.count(F.lit(1)).alias(ROWS)]
    for position, field in enumerate(df.schema.fields):
        counts.append(F.count_if(is_missing(cell(field.name), field.dataType)).alias(f"missing_{position}"))
    return counts


def percentages(df: DataFrame) -> list[Column]:
    """Percent missing per column, over the aggregates of :func:`missing_counts`; 0 without rows."""
    rows = F.nullif(F.col(ROWS), F.lit(0))
    return [
        F.coalesce(F.col(f"missing_{position}") / rows * F.lit(100), F.lit(0.0))
        for position in range(len(df.columns))
    ]


def score(percents: list[Column]) -> Column:
    """100 less the mean percentage; 100 for a table without columns."""
    if not percents:
        return F.lit(100.0)
    total = F.aggregate(F.array(*percents), F.lit(0.0), lambda acc, percent: acc + percent)
    return F.lit(100.0) - total / F.lit(len(percents))


def column_null_percentage(df: DataFrame) -> DataFrame:
    """One row per column: ``column``, ``null_pct``."""
    pairs = [
        F.struct(F.lit(name).alias("column"), percent.alias("null_pct"))
        for name, percent in zip(df.columns, percentages(df))
    ]
    return df.agg(*missing_counts(df)).select(F.inline(F.array(*pairs)))


def data_quality_score(df: DataFrame) -> DataFrame:
    return df.agg(*missing_counts(df)).select(score(percentages(df)).alias("quality_score"))
