"""Clean tables as partitioned Parquet, run summaries and run events as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.session import with_slash

PARTITION_COLUMNS = ["ReportType", "ProcessingDate"]


def clean_path(base: str, report_type: str) -> str:
    return f"{with_slash(base)}{report_type}/"


def summary_path(base: str) -> str:
    return f"{with_slash(base)}summary/"


def partitioning(df: DataFrame) -> list[str]:
    return [name for name in PARTITION_COLUMNS if name in df.columns]


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store, as listings name it; a slash at the end stays."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = file.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(file).toString()
    return with_slash(full) if path.endswith("/") else full


def forbid_stream_table(spark: SparkSession, path: str) -> None:
    """A table with the log of a streaming sink is read by that log: rows a batch adds would never be seen."""
    if exists(spark, f"{path}_spark_metadata"):
        raise ValueError(f"{path} is written by a stream; give the batch job another output folder")


def forbid_batch_table(spark: SparkSession, path: str) -> None:
    """The log of a streaming sink would hide the rows that batch jobs have written before."""
    if exists(spark, f"{path}_SUCCESS"):
        raise ValueError(f"{path} is written by batch jobs; give the stream another output folder")


def forbid_published_table(spark: SparkSession, path: str) -> None:
    """Rows beside the runs of a published table would never be seen."""
    if exists(spark, f"{path}commits"):
        raise ValueError(f"{path} is a published table; give the job another output folder")


def write_clean(df: DataFrame, base: str, report_type: str) -> str:
    """Appends a clean report; returns the path of its table."""
    path = clean_path(base, report_type)
    forbid_stream_table(df.sparkSession, path)
    forbid_published_table(df.sparkSession, path)
    # Spark's default, INT96, has no statistics by which a reader could skip the rows of other runs.
    df.sparkSession.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    df.write.mode("append").option("compression", "snappy").partitionBy(*partitioning(df)).parquet(path)
    return path


def read_clean(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A clean table with the types it was written with; without the schema Spark reads the partition
    value ``ProcessingDate`` as a date."""
    return spark.read.schema(schema).parquet(path)


def read_partition(spark: SparkSession, schema: T.StructType, path: str, report_type: str, date: str) -> DataFrame:
    """One partition of a clean table; Spark prunes the others, and stores empty text as no value."""
    wanted = {"ReportType": report_type, "ProcessingDate": date}
    table = read_clean(spark, schema, path)
    for name, value in wanted.items():
        table = table.where(F.col(name) == value if value else F.col(name).isNull())
    return table


def write_summary(summary: DataFrame, base: str) -> str:
    path = summary_path(base)
    summary.write.mode("append").json(path)
    return path
