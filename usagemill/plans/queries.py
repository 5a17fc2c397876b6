"""The registered queries: every operator over the whole test tables.

Times are shown as microseconds since the epoch and labels as text, so that any engine can compare the rows; values
that depend on the clock are left out or fixed. Queries that write use a new folder below the shared root.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.exposition import label_text
from usagemill.functions.keys import report_date as report_date_of
from usagemill.operators import batches, clean, file_states, quality, routing, samples, stats, summary, telemetry
from usagemill.plans import incremental, report_job
from usagemill.plans.report_job import ReportRun, run_report_job
from usagemill.session import fresh_folder, use_utc
from usagemill.sinks import exposition, file_sizes, tables
from usagemill.sources import notifications, reports, test_tables
from usagemill.sources.header_registry import HeaderRegistry
from usagemill.sources.listing import list_files
from usagemill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

REPORT_DATE = "2024-01-15"
DEFAULT_DATE = "2024-02-01"
INPUT_PATH = "s3://usage-logs/sessions/"
OUTPUT_PATH = "s3://usage-logs/analytics/"
METRICS_URL = "http://metrics.example:8428"
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
RUN = samples.Samples("usage_job", 1_706_745_600_000)


def _micros(*names: str) -> list[Column]:
    return [F.unix_micros(name).alias(name) for name in names]


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "name", F.round("value", 3).alias("value"), label_text(F.col("labels")).alias("labels"), "timestamp_ms"
    )


def _write_csv(df: DataFrame, path: str, header: bool = True, partition: str | None = None) -> None:
    """CSV files with cells as they are: the writer's own trimming is off, so that the reader's is at work."""
    writer = df.write.mode("append").options(
        header=header, escape="\\", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    (writer.partitionBy(partition) if partition else writer).csv(path)


# Cleaning


def _clean_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_sessions(test_tables.usage_sessions(spark, folder))


def _clean_apps(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_applications(test_tables.usage_apps(spark, folder))


def _show_sessions(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "UserId",
        "SessionId",
        *_micros("SessionStartTime", "SessionEndTime"),
        F.round("SessionDurationMinutes", 6).alias("SessionDurationMinutes"),
        *more,
    )


def session_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _show_sessions(_clean_sessions(spark, folder))


def session_duration(spark: SparkSession, folder: str) -> DataFrame:
    durations = _clean_sessions(spark, folder).select("SessionId", "SessionDurationMinutes")
    return _rounded(durations, 6, "SessionDurationMinutes")


def application_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _clean_apps(spark, folder)


def application_duration(spark: SparkSession, folder: str) -> DataFrame:
    return clean.usage_minutes(test_tables.usage_apps(spark, folder)).select(
        "ApplicationUsageTime", "Duration", "UsageDurationMinutes"
    )


def generic_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_report(test_tables.usage_generic(spark, folder), "printers")


def generic_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Generic cleaning of whole texts; the length and a digest stand for the text."""
    cleaned = clean.clean_generic(spark.read.parquet(f"{folder}/documents.parquet"))
    length = F.length("text").cast("bigint").alias("length")
    return cleaned.select("doc_id", "lang", "source", "n_chars", length, F.md5("text").alias("md5"))


def with_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return clean.with_metadata(_clean_apps(spark, folder), "applications", REPORT_DATE).drop("ProcessedAt")


def optional_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A report without an end time and with ``userid`` for ``UserId``: neither the user nor the duration is handled."""
    report = test_tables.usage_sessions(spark, folder)
    report = report.select(F.col("UserId").alias("userid"), "SessionId", "SessionStartTime")
    cleaned = clean.clean_sessions(report)
    return cleaned.withColumns({name: F.unix_micros(name) for name in ["SessionStartTime"]})


# Statistics


def total_records(spark: SparkSession, folder: str) -> DataFrame:
    return stats.total_records(_clean_sessions(spark, folder))


def session_unique_users(spark: SparkSession, folder: str) -> DataFrame:
    return stats.unique_users(_clean_sessions(spark, folder))


def application_unique(spark: SparkSession, folder: str) -> DataFrame:
    return stats.unique_applications(_clean_apps(spark, folder))


def session_duration_stats(spark: SparkSession, folder: str) -> DataFrame:
    result = stats.session_duration_stats(_clean_sessions(spark, folder))
    return _rounded(_rounded(result, 6, "avg_minutes", "max_minutes"), 3, "total_minutes")


def session_duration_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the summary. Quartiles are approximate, so for them it tells whether their rank is off by no more
    than the ten-thousandth of the rows that Spark documents, and leaves out the value."""
    minutes = F.col(stats.DURATION)
    cleaned = _clean_sessions(spark, folder)
    shown = stats.session_duration_summary(cleaned).select("summary", minutes.cast("double").alias("minutes"))
    quartile = F.col("summary").endswith("%")
    found = shown.agg(F.map_from_entries(F.collect_list(F.struct("summary", "minutes"))).alias("found")).scalar()
    values = {name: F.element_at(found, name) for name in QUARTILES}
    ranks = cleaned.agg(
        F.count(minutes).alias("n"),
        *[F.count_if(minutes < value).alias(f"below {name}") for name, value in values.items()],
        *[F.count_if(minutes <= value).alias(f"up to {name}") for name, value in values.items()],
    )
    slack = F.col("n") / F.lit(10_000) + F.lit(1)
    exact = [
        F.struct(
            F.lit(name).alias("summary"),
            ((F.col(f"below {name}") - slack <= share * F.col("n")) & (share * F.col("n") <= F.col(f"up to {name}") + slack))
            .alias("within_accuracy"),
        )
        for name, share in QUARTILES.items()
    ]
    checked = ranks.select(F.inline(F.array(*exact)))
    rounded = F.when(~quartile, F.round("minutes", 6)).alias("minutes")
    return shown.select("summary", rounded).join(F.broadcast(checked), "summary", "left")


def session_duration_summary_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the summary that are not approximate."""
    rows = stats.session_duration_summary(_clean_sessions(spark, folder))
    value = F.round(F.col(stats.DURATION).cast("double"), 6)
    return rows.where(~F.col("summary").contains("%")).select("summary", value.alias("minutes"))


def top_applications(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_applications(_clean_apps(spark, folder))


def top_applications_many(spark: SparkSession, folder: str) -> DataFrame:
    """One application per order: far more than ten, many of them used equally often, all with names that are cut."""
    return stats.top_applications(test_tables.order_applications(spark, folder))


# Quality


def column_null_percentage(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(quality.column_null_percentage(test_tables.usage_sessions(spark, folder)), 6, "null_pct")


def column_null_percentage_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    return _rounded(quality.column_null_percentage(lineitem), 6, "null_pct")


def column_null_percentage_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Text that reads as NaN, and numbers that are NaN, count as missing."""
    return _rounded(quality.column_null_percentage(test_tables.usage_nan(spark, folder)), 6, "null_pct")


def data_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(quality.data_quality_score(test_tables.usage_generic(spark, folder)), 6, "quality_score")


# Routing


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return notifications.parse_notifications(test_tables.notifications(spark, folder), "body")


def route_notifications(spark: SparkSession, folder: str) -> DataFrame:
    return routing.route_notifications(_records(spark, folder), METRICS_URL, OUTPUT_PATH, DEFAULT_DATE)


def report_date(spark: SparkSession, folder: str) -> DataFrame:
    return routing.add_report_date(_records(spark, folder), DEFAULT_DATE).select("event_id", "report_date")


def route_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Notification files written as JSON text, routed by a stream into a table of job arguments."""
    base = fresh_folder(spark, "routing")
    test_tables.notifications(spark, folder).select("body").write.text(f"{base}/in")
    query = ingest.route_stream(
        spark, f"{base}/in", f"{base}/jobs", f"{base}/checkpoint", METRICS_URL, OUTPUT_PATH, DEFAULT_DATE
    )
    query.awaitTermination()
    names = ["metrics_url", "input_path", "output_path", "report_date", "report_type", "trigger_file"]
    return spark.read.schema(reports.text_schema(names)).json(f"{base}/jobs")


# Metric samples


def metric_samples_sessions(spark: SparkSession, folder: str) -> DataFrame:
    raw = test_tables.usage_sessions(spark, folder)
    usage = samples.report_samples(clean.clean_sessions(raw), "sessions", RUN, REPORT_DATE)
    return _flat(usage.unionByName(samples.profile_samples(raw, "sessions", RUN)))


def metric_samples_applications(spark: SparkSession, folder: str) -> DataFrame:
    raw = test_tables.usage_apps(spark, folder)
    usage = samples.report_samples(clean.clean_applications(raw), "applications", RUN, REPORT_DATE)
    return _flat(usage.unionByName(samples.profile_samples(raw, "applications", RUN)))


def metric_samples_generic(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean.clean_report(test_tables.usage_generic(spark, folder), "printers")
    return _flat(samples.report_samples(cleaned, "printers", RUN, REPORT_DATE))


def metric_samples_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(samples.telemetry_samples(test_tables.run_events(spark, folder), RUN))


def exposition_lines(spark: SparkSession, folder: str) -> DataFrame:
    return batches.exposition_lines(test_tables.event_samples(spark, folder)).select("event_id", "line")


def exposition_text(spark: SparkSession, folder: str) -> DataFrame:
    """The lines read back from gzip text files."""
    path = fresh_folder(spark, "exposition")
    exposition.write_text(test_tables.event_samples(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def metric_batches(spark: SparkSession, folder: str) -> DataFrame:
    lines = batches.exposition_lines(test_tables.event_samples(spark, folder))
    numbered = batches.number_batches(lines.select("event_id", "timestamp_ms", "line"), ["timestamp_ms", "event_id"])
    return batches.batch_bodies(numbered)


# Telemetry


def stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    durations = telemetry.stage_durations(test_tables.run_events(spark, folder)).drop("ended_at")
    return _rounded(durations, 3, "seconds")


def job_completion(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(telemetry.job_completion(test_tables.run_events(spark, folder)), 3, "total_seconds")


def job_errors(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.job_errors(test_tables.run_events(spark, folder))


# Sources and sinks


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    _write_csv(test_tables.usage_sessions(spark, folder), path)
    return reports.read_reports(spark, path)


def csv_quoted_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with quotes and separators inside."""
    path = fresh_folder(spark, "csv")
    table = test_tables.usage_generic(spark, folder)
    _write_csv(table.withColumn("n", F.col("n").cast("string")), path)
    return reports.read_reports(spark, path)


def csv_headerless(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    _write_csv(test_tables.usage_sessions(spark, folder), path, header=False)
    return reports.read_reports(spark, path, header=False)


def csv_headerless_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose lines have two to four cells, some with a separator inside quotes."""
    path = fresh_folder(spark, "csv")
    test_tables.uneven_lines(spark, folder).write.text(path)
    return reports.read_reports(spark, path, header=False)


def csv_rescued(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines in files with a header of three names: those with a fourth cell are kept whole beside the cells."""
    path = fresh_folder(spark, "csv")

    def with_header(batches):
        yield pa.record_batch([pa.array(["id,kind,user"])], names=["line"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], names=["line"])

    test_tables.uneven_lines(spark, folder).mapInArrow(with_header, "line string").write.text(path)
    return reports.read_reports(spark, path, rescued="line")


def csv_union_by_header(spark: SparkSession, folder: str) -> DataFrame:
    """Three headers; ``userid`` of the third is another column than ``UserId``, and is shown as ``other_user``."""
    path = fresh_folder(spark, "csv")
    sessions = test_tables.usage_sessions(spark, folder)
    _write_csv(sessions, f"{path}/first")
    _write_csv(test_tables.usage_sessions_reordered(spark, folder), f"{path}/second")
    _write_csv(sessions.select(F.col("UserId").alias("userid"), "SessionId"), f"{path}/third")
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return reports.read_reports(spark, path).withColumnRenamed("userid", "other_user")
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    base = fresh_folder(spark, "clean")
    table = clean.with_metadata(_clean_sessions(spark, folder), "sessions", REPORT_DATE)
    path = tables.write_clean(table, base, "sessions")
    return _show_sessions(tables.read_clean(spark, table.schema, path), "ReportType", "ProcessingDate")


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary written as JSON and read back."""
    base = fresh_folder(spark, "summary")
    row = summary.run_summary(_clean_sessions(spark, folder), "sessions", REPORT_DATE, INPUT_PATH, OUTPUT_PATH)
    path = tables.write_summary(row, base)
    return spark.read.schema(row.schema).json(path).drop("ProcessedAt")


# Streaming and the whole job


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Session reports in one folder per day, taken by two runs of the stream; the second finds nothing new."""
    base = fresh_folder(spark, "ingest")
    _write_csv(test_tables.usage_sessions_by_day(spark, folder), f"{base}/in", partition="day")
    for _ in range(2):
        query = ingest.ingest_reports(
            spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "sessions", test_tables.SESSION_COLUMNS
        )
        query.awaitTermination()
    schema = clean.with_metadata(_clean_sessions(spark, folder), "sessions", REPORT_DATE).schema
    table = tables.read_clean(spark, schema, tables.clean_path(f"{base}/out", "sessions"))
    return _show_sessions(table, "ReportType", "ProcessingDate")


def _age(spark: SparkSession, folder: str, days: int) -> None:
    """Sets the modification times of the files of one folder back."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):
        files.setTimes(found.getPath(), found.getModificationTime() - days * 86_400_000, -1)


def stream_late_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reports that come between two runs of the stream, with files weeks older than those already taken."""
    base = fresh_folder(spark, "ingest")
    report = test_tables.usage_sessions(spark, folder).withColumn("late", F.hash("SessionId") % 2 != 0)
    for late in (False, True):
        part = f"{base}/in/part-{late}"
        _write_csv(report.where(F.col("late") == late).drop("late"), part)
        if late:
            _age(spark, part, days=40)
        query = ingest.ingest_reports(
            spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "sessions", test_tables.SESSION_COLUMNS, REPORT_DATE
        )
        query.awaitTermination()
    schema = clean.with_metadata(_clean_sessions(spark, folder), "sessions", REPORT_DATE).schema
    table = tables.read_clean(spark, schema, tables.clean_path(f"{base}/out", "sessions"))
    return _show_sessions(table, "ReportType", "ProcessingDate")


def stream_report_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Stream in, samples out: application reports taken by the stream, then measured as a table."""
    base = fresh_folder(spark, "ingest")
    apps = test_tables.usage_apps(spark, folder)
    _write_csv(apps, f"{base}/in")
    query = ingest.ingest_reports(
        spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "applications", apps.columns, REPORT_DATE
    )
    query.awaitTermination()
    path = tables.clean_path(f"{base}/out", "applications")
    return _flat(report_job.table_samples(spark, path, "applications", RUN, REPORT_DATE))


# Files taken once, sizes of files, states


def _clean_schema(spark: SparkSession, folder: str):
    return clean.with_metadata(_clean_sessions(spark, folder), "sessions", REPORT_DATE).schema


def job_each_file_once(spark: SparkSession, folder: str) -> DataFrame:
    """The job run three times: on half of the reports, on the same folder again, and after the other half has come."""
    base = fresh_folder(spark, "once")
    report = test_tables.usage_sessions(spark, folder).withColumn("half", F.pmod(F.hash("SessionId"), F.lit(2)))
    run = ReportRun(f"{base}/in", f"{base}/out", "sessions", REPORT_DATE, RUN.job_name, timestamp_ms=RUN.timestamp_ms, once=True)
    for half in (0, None, 1):
        if half is not None:
            _write_csv(report.where(F.col("half") == half).drop("half"), f"{base}/in/{half}")
        run_report_job(spark, run)
    table = incremental.published_table(run.output_base, "sessions", spark)
    return _show_sessions(table.read(spark, _clean_schema(spark, folder)), "ReportType", "ProcessingDate")


def _notify(spark: SparkSession, root: str, path: str) -> None:
    """One notification for each file below the root of a bucket, and one that says a file was removed."""
    key = F.expr(f"substring_index(path, '{root}/', -1)")
    for event in ("ObjectCreated:Put", "ObjectRemoved:Delete"):
        s3 = F.struct(F.struct(F.lit("usage-logs").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object"))
        record = F.struct(F.lit(event).alias("eventName"), s3.alias("s3"))
        listed = list_files(spark, root).select(F.to_json(F.struct(F.array(record).alias("Records"))))
        listed.write.mode("append").text(path)


def notified_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Session reports of many days, taken because notifications name them; then all notifications come once more, to a
    stream that has forgotten them."""
    base = fresh_folder(spark, "notified")
    bucket = f"{base}/store/usage-logs"
    _write_csv(test_tables.usage_sessions_by_day(spark, folder), f"{bucket}/sessions", partition="day")
    _notify(spark, bucket, f"{base}/events")
    for turn in ("first", "replay"):
        query = ingest.ingest_notified(
            spark, f"{base}/events", f"{base}/out", f"{base}/checkpoint-{turn}",
            [incremental.ReportShape("sessions", columns=tuple(test_tables.SESSION_COLUMNS))], turn, object_root=f"{base}/store/", files_per_run=40,
        )
        query.awaitTermination()
    table = incremental.published_table(f"{base}/out", "sessions", spark)
    return _show_sessions(table.read(spark, _clean_schema(spark, folder)), "ReportType", "ProcessingDate")


def _taken_by_day(spark: SparkSession, folder: str, days: Callable = test_tables.usage_sessions_by_day, files_per_run: int = 60):
    """Session reports in folders of days, one half of them taken before the other has come."""
    base = fresh_folder(spark, "days")
    report = days(spark, folder).withColumn("half", F.pmod(F.hash("SessionId"), F.lit(2)))
    date = report_date_of(ingest.below_input(F.col("path"), f"{base}/in"), DEFAULT_DATE)
    for half in (0, 1):
        _write_csv(report.where(F.col("half") == half).drop("half"), f"{base}/in/{half}", partition="day")
        shape = incremental.ReportShape("sessions", columns=tuple(test_tables.SESSION_COLUMNS))
        for _ in incremental.take_folder(spark, f"{base}/in", f"{base}/out", shape, date, files_per_run):
            pass
    return incremental.published_table(f"{base}/out", "sessions", spark)


def compacted_days(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of many days, half of them of one day, taken in several runs and made one: rows of each day, whether it has
    no more files than its rows need, and whether the hot day is split."""
    target = 256 << 10
    table = _taken_by_day(spark, folder, test_tables.usage_sessions_hot_day)
    file_sizes.compact(spark, table, _clean_schema(spark, folder), target)
    # Of many events, some or all runs have files that are not small; these runs are made one all the same.
    file_sizes.compact(spark, table, _clean_schema(spark, folder), target, whole=True)
    rows = table.read(spark, _clean_schema(spark, folder)).groupBy("ProcessingDate").agg(F.count(F.lit(1)).alias("rows"))
    day = F.regexp_extract("path", "ProcessingDate=([0-9-]+)", 1).alias("ProcessingDate")
    files = file_sizes.live_files(spark, table).groupBy(day).agg(F.count(F.lit(1)).alias("files"))
    # A shuffled row of a session report takes under 256 bytes.
    few = F.col("files") <= F.ceil(F.col("rows") * 256 / target) + 1
    return rows.join(files, "ProcessingDate").select("ProcessingDate", "rows", few.alias("few_files"))


def statistics_from_states(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the days up to each day, merged from the states of files; sketched values are shown by whether they
    are within their bounds of the exact ones, which are counted over the rows."""
    table = _taken_by_day(spark, folder)
    states = table.state(spark, "usage", file_states.USAGE_SCHEMA)
    ends = states.select(F.col("date").alias("last")).distinct()
    merged = file_states.merged_usage(states.join(ends, F.col("date") <= F.col("last")), "last")
    rows = table.read(spark, _clean_schema(spark, folder)).select("ProcessingDate", "UserId", stats.DURATION)
    minutes = F.col(stats.DURATION)
    met = rows.join(F.broadcast(merged.withColumnRenamed("users", "estimate")), F.col("ProcessingDate") <= F.col("last"))
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    exact = met.groupBy("last").agg(
        F.count_distinct("UserId").alias("users"),
        F.max("estimate").alias("estimate"),
        F.max("rows").alias("rows"),
        F.max("max_minutes").alias("max_minutes"),
        F.max("total_minutes").alias("total_minutes"),
        F.max("avg_minutes").alias("avg_minutes"),
        F.count(minutes).alias("n"),
        *[F.count_if(minutes < F.col(name)).alias(f"under_{name}") for name in quartiles],
        *[F.count_if(minutes <= F.col(name)).alias(f"upto_{name}") for name in quartiles],
    )
    slack = F.col("n") * F.lit(file_states.QUANTILE_BOUND) + F.lit(1)
    near = [
        (F.col(f"under_{name}") - slack <= share * F.col("n")) & (share * F.col("n") <= F.col(f"upto_{name}") + slack)
        for name, share in quartiles.items()
    ]
    shown = exact.select(
        "last", "rows", "users", "max_minutes", "total_minutes", "avg_minutes",
        (F.abs(F.col("estimate") - F.col("users")) <= F.lit(file_states.DISTINCT_BOUND) * F.col("users")).alias("users_within"),
        (near[0] & near[1] & near[2]).alias("quartiles_within"),
    )
    return _rounded(_rounded(shown, 6, "max_minutes", "avg_minutes"), 3, "total_minutes")


def profile_from_states(spark: SparkSession, folder: str) -> DataFrame:
    """The null profile of all reports, merged from the states of files that were taken at different times."""
    states = _taken_by_day(spark, folder).state(spark, "profile", file_states.PROFILE_SCHEMA)
    return _rounded(file_states.merged_profile(states), 6, "null_pct")


def csv_union_registered(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of ``csv_union_by_header``, whose headers are looked at as the files come, and once."""
    path, registry = fresh_folder(spark, "csv"), HeaderRegistry(fresh_folder(spark, "headers"))
    sessions = test_tables.usage_sessions(spark, folder)
    _write_csv(sessions, f"{path}/first")
    registry.headers(spark, list_files(spark, path))
    _write_csv(test_tables.usage_sessions_reordered(spark, folder), f"{path}/second")
    registry.headers(spark, list_files(spark, path))
    _write_csv(sessions.select(F.col("UserId").alias("other_user"), "SessionId"), f"{path}/third")
    return reports.read_reports(spark, path, headers=registry.headers(spark, list_files(spark, path)))


def top_applications_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most used of very many applications, with only those shuffled by name that may be among them."""
    return stats.top_applications_bounded(test_tables.order_applications(spark, folder))


def _run_job(spark: SparkSession, report: DataFrame, report_type: str):
    base = fresh_folder(spark, "job")
    _write_csv(report, f"{base}/in")
    run = ReportRun(f"{base}/in", f"{base}/out", report_type, REPORT_DATE, RUN.job_name, timestamp_ms=RUN.timestamp_ms)
    return run, run_report_job(spark, run)


def report_job_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table that the whole job leaves behind."""
    run, result = _run_job(spark, test_tables.usage_sessions(spark, folder), "sessions")
    table = tables.read_clean(spark, result.schema, run.clean_path)
    return _show_sessions(table, "ReportType", "ProcessingDate")


def report_job_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of the whole job on application reports, without those that measure time."""
    _, result = _run_job(spark, test_tables.usage_apps(spark, folder), "applications")
    timed = [samples.STAGE_DURATION_SECONDS, samples.JOB_DURATION_SECONDS, samples.JOB_COMPLETED_TOTAL]
    return _flat(result.samples.where(~F.col("name").isin(timed)))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        session_clean,
        session_duration,
        application_clean,
        application_duration,
        generic_clean,
        generic_clean_documents,
        with_metadata,
        optional_columns,
        total_records,
        session_unique_users,
        application_unique,
        session_duration_stats,
        session_duration_summary,
        session_duration_summary_exact,
        top_applications,
        top_applications_many,
        column_null_percentage,
        column_null_percentage_lineitem,
        column_null_percentage_nan,
        data_quality_score,
        route_notifications,
        report_date,
        route_stream,
        metric_samples_sessions,
        metric_samples_applications,
        metric_samples_generic,
        metric_samples_telemetry,
        exposition_lines,
        exposition_text,
        metric_batches,
        stage_durations,
        job_completion,
        job_errors,
        csv_roundtrip,
        csv_quoted_roundtrip,
        csv_headerless,
        csv_headerless_widths,
        csv_rescued,
        csv_union_by_header,
        parquet_roundtrip,
        run_summary,
        stream_ingest,
        stream_late_files,
        stream_report_samples,
        report_job_sessions,
        report_job_samples,
        job_each_file_once,
        notified_ingest,
        compacted_days,
        statistics_from_states,
        profile_from_states,
        csv_union_registered,
        top_applications_bounded,
    ]
}


def registered() -> dict[str, Query]:
    """The queries, each with the session set to UTC first."""

    def in_utc(query: Query) -> Query:
        return lambda spark, folder: query(use_utc(spark), folder)

    return {name: in_utc(query) for name, query in QUERIES.items()}
