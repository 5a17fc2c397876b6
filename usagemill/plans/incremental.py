"""Report files taken once each into a published table, from a folder or by notification.

A run takes a bounded number of files, stages their clean rows, their entries in the manifest and their states, and is
then published as a whole (``sinks/published.py``). What it leaves out or what dies on the way is taken by the next run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.functions.cells import cell
from usagemill.operators.clean import clean_report
from usagemill.operators.file_states import PROFILE_SCHEMA, USAGE_SCHEMA, profile_state, usage_state
from usagemill.operators.samples import Samples, date_samples, merged_quality_samples, report_samples
from usagemill.session import fresh_folder, with_slash
from usagemill.sinks.file_sizes import TARGET_BYTES, by_date, partition_size
from usagemill.sinks.published import SOURCE, PublishedTable
from usagemill.sinks.tables import clean_path, forbid_batch_table, forbid_stream_table
from usagemill.sources.header_registry import HeaderRegistry
from usagemill.sources.listing import as_pattern, list_files
from usagemill.sources.reports import read_reports
from usagemill.sources.stores import store_of

# Files that one run takes at most: their names are what the driver and the plan hold. A backlog takes several runs.
FILES_PER_RUN = 20_000
LONGER_LINE = "_longer_line"
_TAKEN = pa.schema([("path", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("date", pa.string())])


@dataclass(frozen=True)
class ReportShape:
    """How the files of a report are read: with a header line or not, or with a header that is known."""

    report_type: str
    header: bool = True
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Taken:
    """What a run has staged; ``schema`` is that of its clean rows without their file."""

    run: str
    files: int
    rows: int
    longer_lines: int
    schema: T.StructType


def published_table(base: str, report_type: str, spark: SparkSession) -> PublishedTable:
    """The published table of a report type; its folder must not hold a table of another kind."""
    root = clean_path(base, report_type)
    forbid_stream_table(spark, root)
    forbid_batch_table(spark, root)
    return PublishedTable(root)


def registry_of(base: str) -> HeaderRegistry:
    return HeaderRegistry(f"{with_slash(base)}headers")


def stage_files(
    spark: SparkSession, table: PublishedTable, chosen: list[dict], run: str, shape: ReportShape, registry: HeaderRegistry
) -> Taken:
    """Stages the rows, the manifest and the states of a run; ``chosen`` are at most ``FILES_PER_RUN`` files, each with
    the ``date`` of its rows. Headers that are in ``registry`` are not looked at again."""
    files = spark.createDataFrame(pa.Table.from_pylist(chosen, _TAKEN))
    names = [as_pattern(one["file"]) for one in chosen]
    known = list(shape.columns) if shape.columns else None
    headers = registry.headers(spark, files) if shape.header and not known else None
    lines = read_reports(spark, names, shape.header, known, LONGER_LINE, SOURCE, headers)
    if len({name.lower() for name in lines.columns}) < len(lines.columns):
        raise ValueError(f"a report must have no column {SOURCE} or {LONGER_LINE}")
    raw, longer, counted = lines.drop(LONGER_LINE), Observation(), Observation()
    observed = lines.observe(longer, F.count(cell(LONGER_LINE)).alias("lines")).drop(LONGER_LINE)
    dates = {one["date"] for one in chosen}
    clean = clean_report(observed, shape.report_type, aside=[SOURCE]).withColumns(
        {"ProcessedAt": F.current_timestamp(), "ReportType": F.lit(shape.report_type)}
    )
    several = len(dates) > 1
    if not several:
        clean = clean.withColumn("ProcessingDate", F.lit(dates.pop()))
    else:
        # As many rows as the run has files.
        by_file = files.select(F.col("path").alias(SOURCE), F.col("date").alias("ProcessingDate"))
        clean = clean.join(F.broadcast(by_file), SOURCE).select(*clean.columns, "ProcessingDate")
    rows = clean.observe(counted, F.count(F.lit(1)).alias("rows"))
    if several:
        with partition_size(spark, TARGET_BYTES):
            table.stage_rows(by_date(rows), run)
    else:
        table.stage_rows(rows, run)
    table.stage_files(files, run)
    staged = table.staged(spark, clean.schema, run)
    table.stage_state("usage", usage_state(staged, SOURCE, "ProcessingDate"), run)
    table.stage_state("profile", profile_state(raw, SOURCE), run)
    return Taken(run, len(chosen), counted.get["rows"], longer.get["lines"], clean.drop(SOURCE).schema)


def run_samples(spark: SparkSession, table: PublishedTable, taken: Taken, report_type: str, naming: Samples) -> DataFrame:
    """Usage and quality samples of a staged run; records processed are told by date."""
    rows = table.staged(spark, taken.schema, taken.run)
    usage = report_samples(rows, report_type, naming)
    dates = date_samples(table.staged_state(spark, "usage", USAGE_SCHEMA, taken.run), report_type, naming)
    nulls = merged_quality_samples(table.staged_state(spark, "profile", PROFILE_SCHEMA, taken.run), report_type, naming)
    return usage.unionByName(dates).unionByName(nulls)


def choose_files(
    spark: SparkSession, table: PublishedTable, listing: DataFrame, date: Column | str, most: int
) -> list[dict]:
    """The files of a listing that the table does not have yet, the longest waiting first, at most ``most``.

    ``date`` is the date of all their rows, or an expression over the listing.
    """
    dated = F.lit(date) if isinstance(date, str) else date
    waiting = table.pending(spark, listing).orderBy("modified", "path").limit(most)
    return waiting.select("path", "file", "size", "modified", dated.alias("date")).toArrow().to_pylist()


def take_folder(
    spark: SparkSession,
    paths: str | list[str],
    base: str,
    shape: ReportShape,
    date: Column | str,
    files_per_run: int = FILES_PER_RUN,
) -> Iterator[Taken]:
    """Takes all files below folders that the table of the report type does not have, run after run.

    ``date`` is the date of all rows, or an expression over the ``path`` of their file.
    """
    table = published_table(base, shape.report_type, spark)
    while chosen := choose_files(spark, table, list_files(spark, paths), date, files_per_run):
        run = f"folder-{uuid.uuid4().hex}"
        taken = stage_files(spark, table, chosen, run, shape, registry_of(base))
        table.publish(spark, run, taken.files, taken.rows)
        yield taken


def _there(files: DataFrame) -> DataFrame:
    """The rows of ``files`` whose ``trigger_file`` exists; tasks ask the store for each by its name, no folder is listed."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            stores = [store_of(name, named_by_spark=False) for name in batch["trigger_file"]]
            yield batch[[store.get_file_info(name).type == fs.FileType.File for store, name in stores]]

    shape = ", ".join(f"{name} {kind}" for name, kind in files.dtypes)
    return files.mapInPandas(ask, shape)


def _plain(name: str) -> str:
    """A file's name in the one form that Spark gives it."""
    scheme, colon, rest = name.partition(":")
    return f"file:/{rest.lstrip('/')}" if colon and scheme == "file" else name


def take_notified(
    spark: SparkSession,
    jobs: DataFrame,
    base: str,
    shapes: dict[str, ReportShape],
    claim: str,
    files_per_run: int = FILES_PER_RUN,
    naming: Samples | None = None,
    emit: Callable[[DataFrame], None] | None = None,
) -> int:
    """Takes the files that routed notifications name (``report_type, report_date, trigger_file``); returns how many.

    Only these files are asked for. ``claim`` names the batch: a batch that is done again finds the files that it has
    published in the manifest and stages the others anew. Files that are gone are noted in ``<base>missing``. Several
    notifications of one file are one file, under the earliest of their dates. With ``naming`` each run is measured, and
    its samples are handed to ``emit`` once it is published.
    """
    wanted = jobs.groupBy("report_type", "trigger_file").agg(F.min("report_date").alias("report_date"))
    folder = fresh_folder(spark, "claims")
    _there(wanted).write.partitionBy("report_type").parquet(folder)
    found = spark.read.schema("trigger_file string, report_date string, report_type string").parquet(folder)
    gone = wanted.join(found, ["report_type", "trigger_file"], "left_anti")
    if not gone.isEmpty():
        gone.withColumn("claim", F.lit(claim)).write.mode("append").json(f"{with_slash(base)}missing")
    count = 0
    for report_type, shape in shapes.items():
        table = published_table(base, report_type, spark)
        own, last = found.where(F.col("report_type") == report_type), ""
        while part := own.where(F.col("trigger_file") > last).orderBy("trigger_file").limit(files_per_run).collect():
            last = part[-1]["trigger_file"]
            dates = {_plain(row["trigger_file"]): row["report_date"] for row in part}
            listing = list_files(spark, [as_pattern(row["trigger_file"]) for row in part])
            chosen = choose_files(spark, table, listing, "", files_per_run)
            chosen = [one | {"date": dates[_plain(one["file"])]} for one in chosen]
            if not chosen:
                continue
            names = "\n".join(sorted(one["path"] for one in chosen))
            run = f"{claim}-{hashlib.sha256(names.encode()).hexdigest()[:16]}"
            taken = stage_files(spark, table, chosen, run, shape, registry_of(base))
            samples = run_samples(spark, table, taken, report_type, naming) if naming and emit else None
            # As many rows as the report has columns and dates and the fixed catalogue has series.
            held = samples and spark.createDataFrame(samples.toArrow(), samples.schema)
            table.publish(spark, run, taken.files, taken.rows)
            if held:
                emit(held)
            count += taken.files
    return count

