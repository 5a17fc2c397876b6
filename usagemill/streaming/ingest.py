"""Arriving report files and notifications, each processed once.

Both streams are stateless: rows are filtered and projected, and the checkpoint records which files were taken.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagemill.functions.keys import OBJECT_ROOT, report_date
from usagemill.operators.clean import clean_report
from usagemill.operators.routing import route_notifications
from usagemill.operators.samples import Samples
from usagemill.plans.incremental import FILES_PER_RUN, ReportShape, take_notified
from usagemill.session import with_slash
from usagemill.sinks.exposition import Transport, push_samples, write_text
from usagemill.sinks.tables import clean_path, forbid_batch_table, forbid_published_table, partitioning, qualified
from usagemill.sources.notifications import MAX_FILE_AGE, notification_records, rejected_lines, stream_notifications
from usagemill.sources.reports import CSV_FORMAT, text_schema


# Files per batch: a backlog is taken in several batches, and a batch that fails is all that is done again.
FILES_PER_BATCH = 20_000

_GLOB = re.compile(r"[*?\[{]")


def below_input(file_path: Column, input_path: str) -> Column:
    """The part of a file's path below the input folder, or below the folder in which its first wildcard stands."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", input_path)
    wild = _GLOB.search(root)
    root = root[: wild.start()].rpartition("/")[0] if wild else root
    root = quote(re.sub(r"/+", "/", root).rstrip("/") + "/", safe="/:@!$&'()*+,;=~-._")
    start = F.instr(file_path, root)
    return F.when(start > 0, F.substr(file_path, start + F.lit(len(root)))).otherwise(file_path)


def stream_reports(
    spark: SparkSession,
    path: str,
    columns: list[str],
    files_per_batch: int = FILES_PER_BATCH,
    max_file_age: str = MAX_FILE_AGE,
) -> DataFrame:
    """Report files below a folder as a stream; a file with another header ends the query with an error.

    Files that are older than the newest one seen by more than ``max_file_age`` are left out by Spark; the default
    leaves out none. The driver remembers path and time of each file taken within that age.
    """
    reader = spark.readStream.schema(text_schema(columns)).options(
        **CSV_FORMAT, header=True, enforceSchema=False, recursiveFileLookup=True
    )
    return reader.options(maxFilesPerTrigger=files_per_batch, maxFileAge=max_file_age).csv(path)


def clean_stream(raw: DataFrame, report_type: str, date: Column) -> DataFrame:
    """Clean rows with metadata; the date is an expression, as one batch may hold files of several days."""
    return clean_report(raw, report_type).withColumns(
        {"ProcessedAt": F.current_timestamp(), "ReportType": F.lit(report_type), "ProcessingDate": date}
    )


def ingest_reports(
    spark: SparkSession,
    path: str,
    base: str,
    checkpoint: str,
    report_type: str,
    columns: list[str],
    default_date: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the ingest of one report type into its clean table; by default it stops when all files are taken.

    ``ProcessingDate`` is the first date in the path of the file below ``path``, or else ``default_date`` or today.
    """
    table = clean_path(base, report_type)
    forbid_batch_table(spark, table)
    forbid_published_table(spark, table)
    raw = stream_reports(spark, path, columns, files_per_batch)
    date = report_date(below_input(F.col("_metadata.file_path"), path), default_date)
    clean = clean_stream(raw, report_type, date)
    return (
        clean.writeStream.format("parquet")
        .option("compression", "snappy")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partitioning(clean))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def route_stream(
    spark: SparkSession,
    path: str,
    jobs_path: str,
    checkpoint: str,
    metrics_url: str,
    output_path: str,
    default_date: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the routing of arriving notification files into a table of job arguments.

    Text that is no notification is left out here; ``reject_stream`` keeps it.
    """
    records = notification_records(stream_notifications(spark, path, FILES_PER_BATCH))
    jobs = route_notifications(records, metrics_url, output_path, default_date)
    return (
        jobs.writeStream.format("json")
        .option("path", jobs_path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reject_stream(
    spark: SparkSession, path: str, rejects_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the copying of arriving text that is no notification into a table of its own: ``file, line``."""
    lines = rejected_lines(stream_notifications(spark, path, FILES_PER_BATCH))
    return (
        lines.writeStream.format("json")
        .option("path", rejects_path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_notified(
    spark: SparkSession,
    path: str,
    base: str,
    checkpoint: str,
    shapes: list[ReportShape],
    name: str,
    object_root: str = OBJECT_ROOT,
    default_date: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    files_per_run: int = FILES_PER_RUN,
    trigger: dict | None = None,
    naming: Samples | None = None,
    transport: Transport | None = None,
) -> StreamingQuery:
    """Starts the ingest of the files that arriving notifications name into the published tables of their report types.

    Each batch of notifications is routed, and just the files it names are read; no folder is listed. The driver
    remembers notification files only, the reports taken are in the manifests. ``name`` tells streams apart: a batch
    that is done again, as after a crash, takes what it has not yet published, and files that were notified
    more than once are taken once. Buckets are looked for below ``object_root``. With ``naming`` each run is measured as the
    report job does: its samples are written to ``<base>metrics`` and, with a ``transport``, sent once.
    """
    by_type = {shape.report_type: shape for shape in shapes}
    # A root without a scheme is a folder of the default store.
    object_root = object_root if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", object_root) else qualified(spark, object_root)

    def emit(samples: DataFrame) -> None:
        write_text(samples.coalesce(1), f"{with_slash(base)}metrics/")
        if transport:
            # Of the batch's own session, in which the sink must be known.
            push_samples(samples.sparkSession, samples.coalesce(1), transport, ledger=f"{with_slash(base)}pushed")

    def take(batch: DataFrame, number: int) -> None:
        jobs = route_notifications(batch, "", base, default_date, object_root=object_root)
        wanted = jobs.where(F.col("report_type").isin(*by_type))
        take_notified(batch.sparkSession, wanted, base, by_type, f"{name}-{number}", files_per_run, naming, emit)

    records = notification_records(stream_notifications(spark, path, files_per_batch))
    return (
        records.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
