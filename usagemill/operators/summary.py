"""One-row summary of a report run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _summary_columns(total: Column, report_type: str, report_date: str, input_path: str, output_path: str):
    return [
        F.lit(report_type).alias("ReportType"),
        total.alias("TotalRecords"),
        F.lit(report_date).alias("ReportDate"),
        F.lit(input_path).alias("InputPath"),
        F.lit(output_path).alias("OutputPath"),
        F.current_timestamp().alias("ProcessedAt"),
    ]


def run_summary(df: DataFrame, report_type: str, report_date: str, input_path: str, output_path: str) -> DataFrame:
    """Summary that counts the rows of ``df``."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*_summary_columns(F.col("n"), report_type, report_date, input_path, output_path))


def known_summary(
    spark: SparkSession, total: int, report_type: str, report_date: str, input_path: str, output_path: str
) -> DataFrame:
    """Summary for a row count that was already observed while the rows were written."""
    known = F.lit(total).cast("bigint")
    one_row = spark.range(0, 1, 1, 1)
    return one_row.select(*_summary_columns(known, report_type, report_date, input_path, output_path))
