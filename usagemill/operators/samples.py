"""Metric samples as a table: name, value, labels, timestamp in milliseconds.

Samples are rows built from aggregates. All samples of a report that need no grouping come out of one
aggregate over its rows; the top applications and the application totals share one grouped count.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.functions.cells import cell, distinct_values, present
from usagemill.operators import file_states, quality, stats, telemetry

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp_ms", T.LongType()),
    ]
)

# The names of all series and their prefixes, as dashboards read them.
SESSIONS_TOTAL = "appstream_sessions_total"
UNIQUE_USERS = "appstream_unique_users"
AVG_SESSION_MINUTES = "appstream_avg_session_duration_minutes"
MAX_SESSION_MINUTES = "appstream_max_session_duration_minutes"
TOTAL_USAGE_MINUTES = "appstream_total_usage_minutes"
APPLICATION_RECORDS_TOTAL = "appstream_application_records_total"
UNIQUE_APPLICATIONS = "appstream_unique_applications"
TOP_APPLICATIONS_USAGE = "appstream_top_applications_usage"
TOTAL_RECORDS = "appstream_total_records"
LAST_PROCESSED_TIMESTAMP = "appstream_last_processed_timestamp"
RECORDS_PROCESSED_TOTAL = "glue_records_processed_total"
COLUMN_NULL_PERCENTAGE = "glue_column_null_percentage"
DATA_QUALITY_SCORE = "glue_data_quality_score"
STAGE_DURATION_SECONDS = "glue_stage_duration_seconds"
JOB_DURATION_SECONDS = "glue_job_duration_seconds"
JOB_COMPLETED_TOTAL = "glue_job_completed_total"
JOB_ERRORS_TOTAL = "glue_job_errors_total"
USAGE_PREFIX = "appstream_"
JOB_PREFIX = "glue_"


@dataclass(frozen=True)
class Samples:
    """What the samples of one run have in common: the job, the time (now if not given), the prefixes."""

    job_name: str
    timestamp_ms: int | None = None
    usage_prefix: str = USAGE_PREFIX
    job_prefix: str = JOB_PREFIX

    def time_ms(self) -> Column:
        return F.unix_millis(F.current_timestamp()) if self.timestamp_ms is None else F.lit(self.timestamp_ms)

    def time_s(self) -> Column:
        return F.floor(self.time_ms() / F.lit(1000)).cast("bigint")

    def usage(self, name: str, value: Column, **labels: Column | str) -> Column:
        return sample(self.usage_name(name), value, labels, self.time_ms())

    def usage_name(self, name: str) -> str:
        return self.usage_prefix + name.removeprefix(USAGE_PREFIX)

    def job(self, name: str, value: Column, time_ms: Column | None = None, **labels: Column | str) -> Column:
        time_ms = self.time_ms() if time_ms is None else time_ms
        return sample(self.job_prefix + name.removeprefix(JOB_PREFIX), value, labels, time_ms)

    def rows(self, df: DataFrame, samples: list[Column]) -> DataFrame:
        """The given samples of every row of ``df``, one below the other."""
        rows = df.select(F.inline(F.array(*samples)))
        return rows.withColumn("labels", with_job_name(F.col("labels"), F.lit(self.job_name)))

    def dataset(self, report_type: str) -> str:
        return f"{self.usage_prefix}{report_type}_reports"

    def data_type(self, report_type: str) -> str:
        return f"{self.usage_prefix}{report_type}"


def with_job_name(labels: Column, job_name: Column) -> Column:
    """The labels that have a value, with ``job_name`` set last, in place of any label of that name."""
    others = F.map_filter(labels, lambda key, value: (key != F.lit("job_name")) & value.isNotNull())
    return F.map_concat(others, F.create_map(F.lit("job_name"), job_name))


def sample(name: str, value: Column, labels: Mapping[str, Column | str], timestamp_ms: Column) -> Column:
    """One sample as a struct, still without its job."""
    pairs = []
    for key, label in labels.items():
        pairs += [F.lit(key), label.cast("string") if isinstance(label, Column) else F.lit(label)]
    return F.struct(
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        F.create_map(*pairs).cast("map<string,string>").alias("labels"),
        timestamp_ms.cast("bigint").alias("timestamp_ms"),
    )


def _common(run: Samples, report_type: str, report_date: str | None) -> list[Column]:
    """Samples of any report, over a row with its row count in ``rows``."""
    samples = [
        run.usage(TOTAL_RECORDS, F.col("rows"), report_type=report_type),
        run.usage(LAST_PROCESSED_TIMESTAMP, run.time_s(), report_type=report_type),
    ]
    if report_date is not None:
        data_type = run.data_type(report_type)
        samples.append(
            run.job(RECORDS_PROCESSED_TOTAL, F.col("rows"), data_type=data_type, report_date=report_date)
        )
    return samples


def common_samples(
    clean: DataFrame, report_type: str, run: Samples, report_date: str | None = None
) -> DataFrame:
    """Row count and processing time, for any report type; with a date also the records processed for it."""
    return run.rows(clean.agg(F.count(F.lit(1)).alias("rows")), _common(run, report_type, report_date))


def session_samples(clean: DataFrame, run: Samples, report_date: str | None = None) -> DataFrame:
    """Session counts, users and minutes, and the common samples, from one aggregate."""
    report_type = "sessions"
    aggregates = {"rows": F.count(F.lit(1))}
    samples = [run.usage(SESSIONS_TOTAL, F.col("rows"), report_type=report_type)]
    if present(clean, ["UserId"]):
        aggregates["users"] = distinct_values(cell("UserId"))
        samples.append(run.usage(UNIQUE_USERS, F.col("users"), report_type=report_type))
    if present(clean, [stats.DURATION]):
        aggregates |= stats.duration_aggregates()
        samples += [
            run.usage(AVG_SESSION_MINUTES, F.col("avg_minutes")),
            run.usage(MAX_SESSION_MINUTES, F.col("max_minutes")),
            run.usage(TOTAL_USAGE_MINUTES, F.col("total_minutes")),
        ]
    row = clean.agg(*[value.alias(name) for name, value in aggregates.items()])
    return run.rows(row, samples + _common(run, report_type, report_date))


def application_samples(clean: DataFrame, run: Samples, report_date: str | None = None) -> DataFrame:
    """Record counts, applications and the ten most used ones, and the common samples."""
    report_type = "applications"
    records = run.usage(APPLICATION_RECORDS_TOTAL, F.col("rows"), report_type=report_type)
    common = _common(run, report_type, report_date)
    if not present(clean, ["ApplicationName"]):
        return run.rows(clean.agg(F.count(F.lit(1)).alias("rows")), [records, *common])
    counts = stats.application_counts(clean)
    totals = counts.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("applications")
    )
    unique = run.usage(UNIQUE_APPLICATIONS, F.col("applications"), report_type=report_type)
    top = run.usage(
        TOP_APPLICATIONS_USAGE,
        F.col("records"),
        application=F.col("application"),
        rank=F.col("rank"),
        report_type=report_type,
    )
    return run.rows(totals, [records, unique, *common]).unionByName(
        run.rows(stats.rank_applications(counts), [top])
    )


def report_samples(
    clean: DataFrame, report_type: str, run: Samples, report_date: str | None = None
) -> DataFrame:
    """All usage samples of a clean report; an unknown type has the common ones only."""
    if report_type == "sessions":
        return session_samples(clean, run, report_date)
    if report_type == "applications":
        return application_samples(clean, run, report_date)
    return common_samples(clean, report_type, run, report_date)


def quality_samples(profile: DataFrame, raw: DataFrame, report_type: str, run: Samples) -> DataFrame:
    """Missing percentage per column and the score, from one row of ``quality.missing_counts(raw)``."""
    dataset = run.dataset(report_type)
    percents = quality.percentages(raw)
    samples = [
        run.job(COLUMN_NULL_PERCENTAGE, percent, dataset=dataset, column=name)
        for name, percent in zip(raw.columns, percents)
    ]
    samples.append(run.job(DATA_QUALITY_SCORE, quality.score(percents), dataset=dataset))
    return run.rows(profile, samples)


def date_samples(states: DataFrame, report_type: str, run: Samples) -> DataFrame:
    """Records processed for each date, from the usage states of files."""
    counts = states.groupBy("date").agg(F.sum("rows").alias("rows"))
    data_type = run.data_type(report_type)
    return run.rows(counts, [run.job(RECORDS_PROCESSED_TOTAL, F.col("rows"), data_type=data_type, report_date=F.col("date"))])


def merged_quality_samples(states: DataFrame, report_type: str, run: Samples) -> DataFrame:
    """The same samples from the profile states of files (``file_states.py``)."""
    dataset = run.dataset(report_type)
    missing = run.job(COLUMN_NULL_PERCENTAGE, F.col("null_pct"), dataset=dataset, column=F.col("column"))
    whole = run.job(DATA_QUALITY_SCORE, F.col("quality_score"), dataset=dataset)
    columns = run.rows(file_states.merged_profile(states), [missing])
    return columns.unionByName(run.rows(file_states.merged_score(states), [whole]))


def profile_samples(raw: DataFrame, report_type: str, run: Samples) -> DataFrame:
    return quality_samples(raw.agg(*quality.missing_counts(raw)), raw, report_type, run)


def telemetry_samples(events: DataFrame, run: Samples) -> DataFrame:
    """Stage durations, job durations, completions and errors of all runs in an event table.

    Each sample has the time of the event that ended the stage or the run.
    """
    ended_ms = F.unix_millis(F.col("ended_at"))
    stages = run.rows(
        telemetry.stage_durations(events),
        [run.job(STAGE_DURATION_SECONDS, F.col("seconds"), ended_ms, stage=F.col("stage"))],
    )
    jobs = run.rows(
        telemetry.run_durations(events),
        [
            run.job(JOB_DURATION_SECONDS, F.col("seconds"), ended_ms, status=F.col("status")),
            run.job(JOB_COMPLETED_TOTAL, F.lit(1), ended_ms, status=F.col("status")),
        ],
    )
    labels = {"error_type": F.col("error_type"), "report_type": F.col("report_type")}
    errors = run.rows(
        telemetry.error_events(events), [run.job(JOB_ERRORS_TOTAL, F.lit(1), ended_ms, **labels)]
    )
    return stages.unionByName(jobs).unionByName(errors)
