"""Exposition text and its batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.exposition import sample_line
from usagemill.session import fresh_folder

# Fixed value: samples per batch.
BATCH_SIZE = 1000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def exposition_lines(samples: DataFrame) -> DataFrame:
    """Every sample row with its text in ``line``; other columns stay."""
    return samples.withColumn(
        "line", sample_line(F.col("name"), F.col("labels"), F.col("value"), F.col("timestamp_ms"))
    )


def number_batches(
    df: DataFrame, order: list[Column | str], batch_size: int = BATCH_SIZE, folder: str | None = None
) -> DataFrame:
    """Adds ``position`` (from 0, in the given total order) and ``batch_id``, with no task seeing all rows.

    The rows are range-sorted, numbered inside each sorted slice and written to the shared folder, so that both
    readers below see the same slices even when executors are lost. Slice starts are running sums over one row
    per slice; there are at most as many slices as shuffle partitions, which bounds the broadcast. The copy is
    written to a new ``folder``, which the caller may remove when the result has been read.
    """
    spark = df.sparkSession
    folder = folder or fresh_folder(spark, "batches")
    row = F.monotonically_increasing_id()
    df.orderBy(*order).select(
        "*",
        F.shiftright(row, _ROW_BITS).alias("_slice"),
        row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    ).write.parquet(folder)
    sorted_rows = spark.read.parquet(folder)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sorted_rows.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    )
    position = F.col("_start") + F.col("_row")
    return sorted_rows.join(F.broadcast(starts), "_slice").select(
        *[F.col(f"`{name}`") for name in df.columns],
        position.alias("position"),
        F.floor(position / F.lit(batch_size)).cast("bigint").alias("batch_id"),
    )


def batch_bodies(numbered: DataFrame) -> DataFrame:
    """One row per batch: ``batch_id``, ``samples`` and the text ``body``; a batch has a bounded size."""
    in_order = F.array_sort(F.collect_list(F.struct("position", "line")))
    return numbered.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.concat(F.array_join(F.transform(in_order, lambda row: row["line"]), "\n"), F.lit("\n")).alias("body"),
    )
