"""The report job: read the files of one report, clean, write, summarise, and emit metric samples.

The report files are scanned once, whatever the number of columns and metrics. That scan writes the clean table; the
null profile of the raw rows, the lines with cells beyond their header and the count of the clean rows are observed on
the way. The statistics are taken from the columns of the clean table that they need, over the rows of this run.
"""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from usagemill.operators import quality, samples as sample_ops, telemetry
from usagemill.operators.clean import clean_report, with_metadata
from usagemill.operators.summary import known_summary
from usagemill.plans import incremental
from usagemill.session import use_utc, with_slash
from usagemill.sinks.exposition import Transport, push_samples, write_text
from usagemill.sinks.published import PublishedTable
from usagemill.sinks.tables import PARTITION_COLUMNS, clean_path, read_partition, write_clean, write_summary
from usagemill.sources.listing import list_files
from usagemill.sources.reports import read_reports

# The column of lines that have more cells than their header, while the files are read.
LONGER_LINE = "_longer_line"


@dataclass(frozen=True)
class ReportRun:
    """What one run reads and where it writes.

    A job of a routed notification reads its ``trigger_file`` alone, so that the files of one folder are taken once
    each. With ``columns`` no file is opened to look at its header, and any other header is an error. A run to
    ``measure_only`` is one of ``run_table_job`` over the clean table at ``input_path``.
    """

    input_path: str
    output_base: str
    report_type: str
    report_date: str
    job_name: str
    header: bool = True
    timestamp_ms: int | None = None
    transport: Transport | None = None
    trigger_file: str | None = None
    columns: tuple[str, ...] | None = None
    measure_only: bool = False
    once: bool = False

    @property
    def reads(self) -> str:
        return self.trigger_file or self.input_path

    @property
    def clean_path(self) -> str:
        return clean_path(self.output_base, self.report_type)

    @property
    def metrics_path(self) -> str:
        return f"{with_slash(self.output_base)}metrics/"

    @property
    def events_path(self) -> str:
        return f"{with_slash(self.output_base)}run_events/"


@dataclass(frozen=True)
class ReportResult:
    """``longer_lines`` counts the lines with more cells than their header names; ``read_reports`` lists them."""

    total_records: int
    longer_lines: int
    schema: T.StructType
    samples: DataFrame


class _RunLog:
    """Events of this run: a few rows on the driver, appended to the event table when the run is over."""

    def __init__(self, run: ReportRun):
        self.run, self.run_id, self.rows = run, uuid.uuid4().hex, []

    def add(self, kind: str, stage=None, status=None, error_type=None, error_message=None) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self.rows.append(
            (self.run_id, len(self.rows), now, kind, stage, self.run.report_type, status, error_type, error_message)
        )

    @contextmanager
    def stage(self, name: str):
        self.add(telemetry.STAGE_START, name)
        yield
        self.add(telemetry.STAGE_END, name)

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = telemetry.RUN_EVENTS_SCHEMA
        columns = [list(column) for column in zip(*self.rows)]
        arrays = [pa.array(column, field.type) for column, field in zip(columns, to_arrow_schema(schema))]
        return spark.createDataFrame(pa.Table.from_arrays(arrays, schema.names), schema).coalesce(1)


def _one_row(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(*[F.lit(value).cast("bigint").alias(name) for name, value in values.items()])


def _held(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows of a small frame, worked out once."""
    return spark.createDataFrame(rows.toArrow(), rows.schema)


def _rows_of_run(spark: SparkSession, run: ReportRun, schema: T.StructType, counted: dict) -> DataFrame:
    """The rows this run has written, told by their processing time; the table may hold rows of other runs."""
    if counted["rows"] == 0:
        return spark.createDataFrame([], schema)
    time = F.timestamp_micros(F.lit(counted["processed_us"]).cast("bigint"))
    rows = read_partition(spark, schema, run.clean_path, run.report_type, run.report_date)
    return rows.where(F.col("ProcessedAt") == time)


def _check_total(samples: DataFrame, naming: sample_ops.Samples, total: int) -> None:
    """Another run may have written rows under the same date in the same microsecond; none is told apart then."""
    series = naming.usage_name(sample_ops.TOTAL_RECORDS)
    found = samples.where(F.col("name") == series).first()["value"]
    if found != total:
        raise RuntimeError(f"{total} rows were written, but {found:.0f} carry the processing time of this run")


def _process(spark: SparkSession, run: ReportRun, log: _RunLog, naming: sample_ops.Samples) -> ReportResult:
    with log.stage("extraction"):
        known = list(run.columns) if run.columns else None
        lines = read_reports(spark, run.reads, run.header, known, rescued=LONGER_LINE)
        longer = Observation()
        raw = lines.observe(longer, F.count(LONGER_LINE).alias("lines")).drop(LONGER_LINE)
    with log.stage("transformation"):
        profile, counted = Observation(), Observation()
        observed = clean_report(raw.observe(profile, *quality.missing_counts(raw)), run.report_type).observe(
            counted,
            F.count(F.lit(1)).alias("rows"),
            F.max(F.unix_micros(F.current_timestamp())).alias("processed_us"),
        )
        # The metadata come last, so that Spark sees constant partition columns and need not sort the rows for them.
        clean = with_metadata(observed, run.report_type, run.report_date)
    with log.stage("loading"):
        write_clean(clean, run.output_base, run.report_type)
        total = counted.get["rows"]
        summary = known_summary(
            spark, total, run.report_type, run.report_date, run.reads, run.clean_path
        )
        write_summary(summary, run.output_base)
    with log.stage("analytics"):
        written = _rows_of_run(spark, run, clean.schema, counted.get)
        usage = sample_ops.report_samples(written, run.report_type, naming, run.report_date)
        nulls = sample_ops.quality_samples(_one_row(spark, profile.get), raw, run.report_type, naming)
        # As many rows as the report has columns and the fixed catalogue has series; written and sent below.
        samples = _held(spark, usage.unionByName(nulls))
        _check_total(samples, naming, total)
    return ReportResult(total, longer.get["lines"], clean.schema, samples)


def _process_once(spark: SparkSession, run: ReportRun, log: _RunLog, naming: sample_ops.Samples) -> ReportResult:
    """As ``_process`` for the files that the published table does not have; nothing of them is seen until the end."""
    table = incremental.published_table(run.output_base, run.report_type, spark)
    shape = incremental.ReportShape(run.report_type, run.header, run.columns)
    with log.stage("extraction"):
        listing = list_files(spark, run.reads)
        chosen = incremental.choose_files(spark, table, listing, run.report_date, incremental.FILES_PER_RUN)
    if not chosen:
        return ReportResult(0, 0, T.StructType(), spark.createDataFrame([], sample_ops.SAMPLE_SCHEMA))
    with log.stage("transformation"):
        registry = incremental.registry_of(run.output_base)
        taken = incremental.stage_files(spark, table, chosen, log.run_id, shape, registry)
    with log.stage("analytics"):
        samples = _held(spark, incremental.run_samples(spark, table, taken, run.report_type, naming))
    with log.stage("loading"):
        table.publish(spark, log.run_id, taken.files, taken.rows)
        summary = known_summary(spark, taken.rows, run.report_type, run.report_date, run.reads, run.clean_path)
        write_summary(summary, run.output_base)
    return ReportResult(taken.rows, taken.longer_lines, taken.schema, samples)


def _emit(spark: SparkSession, run: ReportRun, samples: DataFrame) -> None:
    write_text(samples.coalesce(1), run.metrics_path)
    if run.transport:
        push_samples(spark, samples.coalesce(1), run.transport, ledger=f"{with_slash(run.output_base)}pushed")


def _close(spark: SparkSession, run: ReportRun, log: _RunLog, naming: sample_ops.Samples) -> DataFrame:
    """Appends the run's events and returns their samples, which are as few as the events."""
    events = log.frame(spark)
    events.write.mode("append").json(run.events_path)
    return _held(spark, sample_ops.telemetry_samples(events, naming))


def run_report_job(spark: SparkSession, run: ReportRun) -> ReportResult:
    """Runs the job once; a failure is logged and measured, then raised."""
    use_utc(spark)
    log = _RunLog(run)
    naming = sample_ops.Samples(run.job_name, run.timestamp_ms)
    log.add(telemetry.JOB_START)
    try:
        result = (_process_once if run.once else _process)(spark, run, log, naming)
    except Exception as problem:
        log.add(telemetry.JOB_END, None, telemetry.FAILED, type(problem).__name__, str(problem))
        try:
            _emit(spark, run, _close(spark, run, log, naming))
        except Exception as second:
            problem.add_note(f"the failure could not be reported: {second}")
        raise
    log.add(telemetry.JOB_END, status="success")
    samples = result.samples.unionByName(_close(spark, run, log, naming))
    _emit(spark, run, samples)
    return replace(result, samples=samples)


def table_samples(
    spark: SparkSession, path: str, report_type: str, naming: sample_ops.Samples, report_date: str | None = None
) -> DataFrame:
    """Usage and quality samples of a clean table that a stream or a batch job has written, published or not, for one date
    or all.

    The statistics read the columns they need, and of the dates only the given one.
    """
    published = PublishedTable(with_slash(path))
    table = published.read_all(spark) if published.is_there(spark) else use_utc(spark).read.parquet(path)
    if report_date is not None:
        table = table.where(F.col("ProcessingDate").cast("string") == report_date)
    report = table.drop("ProcessedAt", *PARTITION_COLUMNS)
    usage = sample_ops.report_samples(report, report_type, naming, report_date)
    return usage.unionByName(sample_ops.profile_samples(report, report_type, naming))


def run_table_job(
    spark: SparkSession,
    path: str,
    output_base: str,
    report_type: str,
    job_name: str,
    report_date: str | None = None,
    timestamp_ms: int | None = None,
    transport: Transport | None = None,
) -> DataFrame:
    """Measures a clean table once: writes the exposition text, sends it where a transport is given, returns it."""
    naming = sample_ops.Samples(job_name, timestamp_ms)
    samples = _held(spark, table_samples(spark, path, report_type, naming, report_date))
    write_text(samples.coalesce(1), f"{with_slash(output_base)}metrics/")
    if transport:
        push_samples(spark, samples.coalesce(1), transport, ledger=f"{with_slash(output_base)}pushed")
    return samples
