"""The ``events`` test table seen as usage reports, notifications and run events.

Every view has one row per event and leaves none out. The remainders of ``event_id`` only decide which cells are
blank, padded or unreadable, so that the cleaning steps have something to do and both engines agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_COLUMNS = ["UserId", "SessionId", "SessionStartTime", "SessionEndTime"]
_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _blank(blank: Column, value: Column) -> Column:
    return F.when(~blank, value)


def _user() -> Column:
    return _blank(_every(17), F.concat(F.lit("  user"), F.col("user_id").cast("string"), F.lit(" ")))


def _session_columns() -> list[Column]:
    sign = F.when(_every(37), F.lit(-1)).otherwise(F.lit(1))
    seconds = (sign * F.round(F.col("value") * 60)).cast("decimal(18,6)")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return [
        _user().alias("UserId"),
        _blank(_every(29), F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("SessionId"),
        F.when(_every(23), "n/a").otherwise(F.date_format("ts", _TIME_FORMAT)).alias("SessionStartTime"),
        _blank(_every(31), F.date_format(end, _TIME_FORMAT)).alias("SessionEndTime"),
    ]


def usage_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(*_session_columns())


def usage_sessions_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Session reports with the day of the event, to be written as one folder per day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return events(spark, folder).select(*_session_columns(), day.alias("day"))


def usage_sessions_hot_day(spark: SparkSession, folder: str) -> DataFrame:
    """As ``usage_sessions_by_day``, with every other event put on one day."""
    hot = F.when(_every(2), "2024-01-15").otherwise(F.col("day"))
    by_day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events(spark, folder).select(*_session_columns(), by_day, "event_id").withColumn("day", hot).drop("event_id")


def usage_sessions_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """The same reports under another header: two columns swapped, two missing, one more."""
    return events(spark, folder).select(*_session_columns(), F.col("event_type").alias("Extra")).select(
        "SessionId", "UserId", "Extra"
    )


def usage_apps(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))
    minutes = F.round(F.col("value")).cast("bigint").cast("string")
    return events(spark, folder).select(
        _blank(_every(19), name).alias("ApplicationName"),
        _user().alias("UserId"),
        F.when(_every(13), "unknown").otherwise(minutes).alias("ApplicationUsageTime"),
        F.lit("999").alias("Duration"),
    )


def usage_generic(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        _blank(_every(11), F.concat(F.lit(" "), F.col("event_type"), F.lit("  "))).alias("a"),
        _blank(_every(11) | _every(3), F.col("props")).alias("b"),
        _blank(_every(11), F.col("value")).alias("n"),
    )


def usage_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Text and numbers, some of them not a number."""
    return events(spark, folder).select(
        F.when(_every(7), "NaN").when(_every(5), " nan ").when(_every(3), None).otherwise(F.col("event_type")).alias("text"),
        F.when(_every(4), F.lit(float("nan"))).when(_every(9), None).otherwise(F.col("value")).alias("number"),
        F.when(_every(6), F.lit(float("nan"))).otherwise(F.col("value")).cast("float").alias("single"),
    )


def order_applications(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, under an application name of more than 50 characters per order."""
    name = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" handled by " + "office " * 8))
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(name.alias("ApplicationName"))


def uneven_lines(spark: SparkSession, folder: str) -> DataFrame:
    """CSV lines of two to four cells; the second cell holds a separator inside quotes."""
    cells = [
        F.col("event_id").cast("string"),
        F.concat(F.lit('"'), F.col("event_type"), F.lit(',x"')),
        F.when(~_every(3), F.col("user_id").cast("string")),
        F.when(_every(4) & ~_every(3), F.lit("beyond")),
    ]
    return events(spark, folder).select(F.concat_ws(",", *cells).alias("line"))


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON notification per event: ``event_id, body``."""
    kind, event_id = F.col("event_type"), F.col("event_id").cast("string")
    path, day = F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "yyyy-MM-dd")
    name = (
        F.when(kind == "error", "ObjectRemoved:Delete")
        .when(kind == "signup", "ObjectCreated:Post")
        .otherwise("ObjectCreated:Put")
    )
    key = (
        F.when(kind == "view", F.concat(F.lit("applications/"), path, F.lit("/used-"), day, F.lit(".csv")))
        .when(kind == "purchase", F.concat(F.lit("applications/latest/app-"), event_id, F.lit(".csv")))
        .when(kind == "signup", F.concat(F.lit("analytics/part-"), event_id, F.lit(".parquet")))
        .otherwise(F.concat(F.lit("sessions/"), path, F.lit("/log-"), day, F.lit(".csv")))
    )
    bucket = F.struct(F.lit("usage-logs").alias("name"))
    s3 = F.struct(bucket.alias("bucket"), F.struct(key.alias("key")).alias("object"))
    record = F.struct(name.alias("eventName"), s3.alias("s3"))
    body = F.to_json(F.struct(F.array(record).alias("Records")))
    return events(spark, folder).select("event_id", body.alias("body"))


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    failed = (kind == "error") & _every(2)
    return events(spark, folder).select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("click", "view"), "stage_start")
        .when(kind.isin("purchase", "signup"), "stage_end")
        .otherwise("job_end")
        .alias("kind"),
        F.when(kind.isin("click", "signup"), "extraction")
        .when(kind.isin("view", "purchase"), "transformation")
        .alias("stage"),
        F.when(F.col("user_id") % 2 == 0, "sessions").otherwise("applications").alias("report_type"),
        F.when(failed, "failed").when(kind == "error", "success").alias("status"),
        F.when(failed & _every(4), "AnalysisException").when(failed, "ValueError").alias("error_type"),
        F.when(failed & _every(6), "").when(failed, "boom").alias("error_message"),
    )


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    """One metric sample per event."""
    labels = F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("job_name"), F.lit("usage_job")
    )
    return events(spark, folder).select(
        "event_id",
        F.lit("event_value").alias("name"),
        F.col("value"),
        labels.alias("labels"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
    )
