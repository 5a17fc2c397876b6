"""New-object notifications: JSON documents, each with a list of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the parts of a notification that routing reads.
NOTIFICATION_SCHEMA = (
    "Records array<struct<eventName: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"
)

# Spark's file streams leave out files that are older than the newest by more than this; no file is that old.
MAX_FILE_AGE = "36500d"


def notification_records(notifications: DataFrame) -> DataFrame:
    """One row per record: ``event_name, bucket, key``; other columns of ``notifications`` stay.

    The outer explode keeps Spark from testing the list before it is exploded, which would parse JSON text once
    more for each test.
    """
    others = [name for name in notifications.columns if name != "Records"]
    records = notifications.select(*others, F.explode_outer("Records").alias("record"))
    return records.where(F.col("record").isNotNull()).select(
        *others,
        F.col("record.eventName").alias("event_name"),
        F.col("record.s3.bucket.name").alias("bucket"),
        F.col("record.s3.object.key").alias("key"),
    )


def parse_notifications(df: DataFrame, text_column: str) -> DataFrame:
    """Records of notifications that are held as JSON text in a column."""
    others = [name for name in df.columns if name != text_column]
    parsed = F.from_json(F.col(text_column), NOTIFICATION_SCHEMA, {"mode": "FAILFAST"})
    return notification_records(df.select(*others, parsed["Records"].alias("Records")))


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return notification_records(spark.read.schema(NOTIFICATION_SCHEMA).option("mode", "FAILFAST").json(path))


def stream_notifications(
    spark: SparkSession, path: str, files_per_batch: int | None = None, max_file_age: str = MAX_FILE_AGE
) -> DataFrame:
    """Arriving notifications, ``Records``, with ``file`` and ``bad_line``: text that is none, else NULL.

    One bad file must not end the stream for ever, so bad lines are rows of their own; ``rejected_lines`` has them.
    """
    reader = spark.readStream.schema(f"{NOTIFICATION_SCHEMA}, bad_line string").options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="bad_line", maxFileAge=max_file_age
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select("Records", "bad_line", F.col("_metadata.file_path").alias("file"))


def rejected_lines(notifications: DataFrame) -> DataFrame:
    """``file, line`` of text that is no notification."""
    # Spark fills the column of bad lines only where another one is read as well.
    bad = F.col("bad_line").isNotNull() & F.col("Records").isNull()
    return notifications.where(bad).select("file", F.col("bad_line").alias("line"))
