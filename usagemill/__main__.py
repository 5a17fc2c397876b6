"""Runs the report job once.

Locally ``python -m usagemill --job-name ...``; on a cluster, with the package zipped,
``spark-submit --py-files usagemill.zip usagemill/__main__.py --job-name ...``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from usagemill.plans.report_job import ReportRun, run_report_job, run_table_job
from usagemill.sinks.exposition import http_transport


def parse(arguments: Sequence[str] | None = None) -> ReportRun:
    parser = argparse.ArgumentParser(prog="usagemill", description="Process the usage reports below one folder.")
    parser.add_argument("--job-name", required=True)
    parser.add_argument("--input-path", required=True, help="folder of the report files, or one file")
    parser.add_argument("--output-path", required=True, help="folder of the clean tables, summaries and metrics")
    parser.add_argument("--report-type", required=True, help="sessions, applications, or any other")
    parser.add_argument("--report-date", required=True, help="yyyy-MM-dd")
    parser.add_argument("--metrics-url", help="server that takes the metric samples; without it they are only written")
    parser.add_argument("--no-header", action="store_true", help="the files have no header line")
    parser.add_argument("--trigger-file", help="the one file below the folder that this run is for")
    parser.add_argument("--columns", help="the header that all files have, as names with commas between")
    parser.add_argument(
        "--measure-only", action="store_true", help="the input is a clean table: only measure it for the date"
    )
    parser.add_argument("--once", action="store_true", help="take only files that no run with --once has taken before")
    given = parser.parse_args(arguments)
    return ReportRun(
        given.input_path,
        given.output_path,
        given.report_type,
        given.report_date,
        given.job_name,
        header=not given.no_header,
        transport=http_transport(given.metrics_url) if given.metrics_url else None,
        trigger_file=given.trigger_file,
        columns=tuple(given.columns.split(",")) if given.columns else None,
        measure_only=given.measure_only,
        once=given.once,
    )


def main(arguments: Sequence[str] | None = None) -> None:
    run = parse(arguments)
    spark = SparkSession.builder.appName(run.job_name).getOrCreate()
    try:
        if run.measure_only:
            run_table_job(
                spark,
                run.input_path,
                run.output_base,
                run.report_type,
                run.job_name,
                run.report_date,
                transport=run.transport,
            )
            print(f"{run.input_path} measured")
            return
        result = run_report_job(spark, run)
        print(f"{result.total_records} records written to {run.clean_path}")
        if result.longer_lines:
            print(f"{result.longer_lines} lines have more cells than their header")
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
