"""Routing of new-object notifications to report jobs, one row per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.functions import keys
from usagemill.session import with_slash


def add_report_date(notifications: DataFrame, default_date: str | None = None) -> DataFrame:
    return notifications.withColumn("report_date", keys.report_date(F.col("key"), default_date))


def unroutable(notifications: DataFrame) -> DataFrame:
    """Created-object notifications that lack the bucket or the key, so that no job can be made of them."""
    created = F.col("event_name").startswith("ObjectCreated")
    return notifications.where(created & (F.col("bucket").isNull() | F.col("key").isNull()))


def route_notifications(
    notifications: DataFrame,
    metrics_url: str,
    output_path: str,
    default_date: str | None = None,
    decode_keys: bool = False,
    object_root: str = keys.OBJECT_ROOT,
) -> DataFrame:
    """Arguments of one job for every created report file; other events and folders are left out, and so are
    notifications without a bucket or a key, which ``unroutable`` lists.

    ``notifications`` has ``event_name``, ``bucket`` and ``key``. Object stores may percent-encode keys;
    ``decode_keys`` undoes that. Buckets are below ``object_root``. Works on a batch or a stream.
    """
    if decode_keys:
        notifications = notifications.withColumn("key", F.try_url_decode(F.col("key")))
    named = notifications.where(F.col("bucket").isNotNull() & F.col("key").isNotNull())
    created = named.where(F.col("event_name").startswith("ObjectCreated")).withColumn(
        "report_type", keys.report_type(F.col("key"))
    )
    bucket, key = F.col("bucket"), F.col("key")
    return add_report_date(created.where(F.col("report_type").isNotNull()), default_date).select(
        F.lit(metrics_url).alias("metrics_url"),
        F.concat(keys.object_uri(bucket, keys.folder_of(key), object_root), F.lit("/")).alias("input_path"),
        F.lit(with_slash(output_path)).alias("output_path"),
        F.col("report_date"),
        F.col("report_type"),
        keys.object_uri(bucket, key, object_root).alias("trigger_file"),
    )
