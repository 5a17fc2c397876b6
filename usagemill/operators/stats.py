"""Usage statistics. Each is one aggregate with partial sums built before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.cells import cell

DURATION = "SessionDurationMinutes"


def total_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def distinct_count(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Number of different values in a column, NULL counting as one."""
    return df.select(cell(column)).distinct().agg(F.count(F.lit(1)).alias(alias))


def unique_users(df: DataFrame) -> DataFrame:
    return distinct_count(df, "UserId", "unique_users")


def unique_applications(df: DataFrame) -> DataFrame:
    return distinct_count(df, "ApplicationName", "unique_applications")


def duration_aggregates() -> dict:
    """Average, longest and total session minutes; 0 where no session has a duration."""
    minutes = F.col(DURATION)
    parts = {"avg_minutes": F.avg(minutes), "max_minutes": F.max(minutes), "total_minutes": F.sum(minutes)}
    return {name: F.coalesce(value, F.lit(0.0)) for name, value in parts.items()}


def session_duration_stats(df: DataFrame) -> DataFrame:
    return df.agg(*[value.alias(name) for name, value in duration_aggregates().items()])


def session_duration_summary(df: DataFrame) -> DataFrame:
    """Count, mean, stddev, min, quartiles (approximate) and max, as text cells."""
    return df.select(DURATION).summary()


def application_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ApplicationName").agg(F.count(F.lit(1)).alias("records"))


def rank_applications(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest counts, ranked from 1; equal counts rank by name.

    The limit stands before the window, so the window, which has no partition, sees ``n`` rows.
    """
    order = [F.desc("records"), F.asc("ApplicationName")]
    return counts.orderBy(*order).limit(n).select(
        F.substr(F.col("ApplicationName"), F.lit(1), F.lit(50)).alias("application"),
        F.col("records"),
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
    )


def top_applications(df: DataFrame, n: int = 10) -> DataFrame:
    return rank_applications(application_counts(df), n)


# Cells into which names are hashed by the bounded count, and how many of the fullest are looked into at first.
CELLS = 1 << 20
FIRST_CELLS = 1 << 10


def top_applications_bounded(df: DataFrame, n: int = 10, cells: int = CELLS) -> DataFrame:
    """As ``top_applications``, for very many names: names that cannot be among the first ``n`` are not shuffled.

    Tasks send the counts of hashed cells, at most ``cells`` numbers each. No name occurs more often than its cell.
    The names of the fullest cells are counted, and the ``n``-th of these counts is a threshold that the true ``n``-th
    one reaches; then the names of all cells that reach it are counted. If very many do, as when all names are about
    equally frequent, this shuffles as much as one grouped count, and the result is the same.
    """
    name = F.col("ApplicationName")
    own = df.select("ApplicationName", F.pmod(F.xxhash64(name), F.lit(cells)).cast("int").alias("_cell"))
    totals = own.groupBy("_cell").agg(F.count(F.lit(1)).alias("_total"))
    fullest = totals.orderBy(F.desc("_total"), "_cell").limit(FIRST_CELLS)
    # The lists of cells hold at most as many numbers as there are cells, 12 MB.
    first = application_counts(own.join(F.broadcast(fullest.select("_cell")), "_cell"))
    least = first.orderBy(F.desc("records")).limit(n).agg(
        F.when(F.count(F.lit(1)) == n, F.min("records")).otherwise(F.lit(0)).alias("_least")
    )
    reaching = totals.where(F.col("_total") >= least.scalar()).select("_cell")
    return rank_applications(application_counts(own.join(F.broadcast(reaching), "_cell")), n)
