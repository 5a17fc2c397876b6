"""Sizes of the files of clean tables: rows gathered by date before a write, and small runs made one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.operators.file_states import PROFILE_SCHEMA, USAGE_SCHEMA
from usagemill.sinks.published import FILES_SCHEMA, RUN, SOURCE, PublishedTable
from usagemill.sinks.tables import exists, partitioning
from usagemill.sources.listing import list_files

# Bytes of rows, as they are shuffled, that go into one file.
TARGET_BYTES = 256 << 20
_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
STATES = {"usage": USAGE_SCHEMA, "profile": PROFILE_SCHEMA}


@contextmanager
def partition_size(spark: SparkSession, target: int) -> Iterator[None]:
    """Adaptive execution aims at partitions of ``target`` bytes while this is open."""
    before = spark.conf.get(_SIZE, None)
    spark.conf.set(_SIZE, str(target))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SIZE)
        else:
            spark.conf.set(_SIZE, before)


def by_date(rows: DataFrame) -> DataFrame:
    """Rows of unknown dates gathered by date: adaptive execution makes tasks of the size that it aims at, of several
    dates with few rows or of a part of a hot one. Dates that share a reducer with a hot one are split with it."""
    return rows.hint("rebalance", *partitioning(rows))


def in_files(spark: SparkSession, rows: DataFrame, counts: DataFrame, rows_per_file: int) -> DataFrame:
    """Rows dealt so that each date gets as many files as its rows need, each from a task of its own.

    ``counts`` has ``date, rows``, a row for each date of ``rows``; files are numbered over these few rows.
    """
    files = counts.select("date", F.ceil(F.col("rows") / F.lit(rows_per_file)).alias("_files"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_first", F.coalesce(F.sum("_files").over(before), F.lit(0)))
    files = spark.createDataFrame(files.toArrow())
    number = files.agg(F.sum("_files")).first()[0] or 1
    dealt = rows.join(F.broadcast(files), F.col("ProcessingDate").eqNullSafe(F.col("date")))
    file = (F.col("_first") + F.pmod(F.xxhash64(*rows.columns), F.col("_files"))).cast("int").alias("_file")
    return dealt.select(*rows.columns, file).repartitionById(number, "_file").drop("_file")


def live_files(spark: SparkSession, table: PublishedTable) -> DataFrame:
    """``path, file, size, modified, run`` of the files with rows of live runs; those of other runs may still lie beside them."""
    folder = f"{table.root.rstrip('/')}/rows"
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{FILES_SCHEMA}, {RUN} string")
    run = F.regexp_extract("path", f"/{RUN}=([^/]+)/", 1)
    return list_files(spark, folder).withColumn(RUN, run).join(table.live_runs(spark).select(RUN), RUN, "left_semi")


def small_runs(spark: SparkSession, table: PublishedTable, target: int) -> list[str]:
    """Live runs whose files are on average smaller than a quarter of ``target``, if there are several."""
    sizes = live_files(spark, table).groupBy(RUN).agg(F.avg("size").alias("size"))
    small = sizes.where(F.col("size") < target / 4)
    found = [row[RUN] for row in small.orderBy(RUN).select(RUN).collect()]
    return found if len(found) > 1 else []


def _all_runs(spark: SparkSession, table: PublishedTable) -> list[str]:
    """All live runs, if there are several."""
    found = [row[RUN] for row in table.live_runs(spark).orderBy(RUN).select(RUN).collect()]
    return found if len(found) > 1 else []


def _rows_per_file(spark: SparkSession, table: PublishedTable, runs: list[str], target: int) -> int:
    """Rows that make a file of ``target`` bytes, by the bytes that the rows of some runs take now."""
    folder = f"{table.root.rstrip('/')}/rows"
    size = sum(
        list_files(spark, [f"{folder}/{RUN}={run}" for run in runs]).agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    )
    rows = table.commits(spark).where(F.col("run").isin(runs)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return max(1, int(target * max(rows, 1) / max(size, 1)))


def compact(
    spark: SparkSession, table: PublishedTable, schema: T.StructType, target: int = TARGET_BYTES, whole: bool = False
) -> str | None:
    """Makes one run of the small ones: their rows by date in files of about ``target`` bytes, their manifest and states.
    With ``whole`` it is made of all live runs, however large their files are.

    Readers see the old runs up to the publication and the new one from then on. Files that no longer count are left
    out. A run that is replaced by two compactions at once is a case for the manifest: each file counts once. The name
    of the new run is returned, or None if there are not several such runs.
    """
    old = _all_runs(spark, table) if whole else small_runs(spark, table, target)
    if not old:
        return None
    run = f"compact-{uuid.uuid4().hex}"
    rows = table.read(spark, schema, with_source=True).where(F.col(RUN).isin(old)).drop(RUN)
    counts = rows.groupBy(F.col("ProcessingDate").alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    table.stage_rows(in_files(spark, rows, counts, _rows_per_file(spark, table, old, target)), run)
    files = table.files(spark).where(F.col(RUN).isin(old))
    table.stage_files(files, run)
    for name, shape in STATES.items():
        state = table.state(spark, name, shape)
        table.stage_state(name, state.join(files.select("path"), "path", "left_semi"), run)
    table.publish(spark, run, files.count(), table.staged(spark, schema, run).count(), old)
    return run
