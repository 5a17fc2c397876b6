"""Files below folders, as a table; nothing is opened."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GLOB = re.compile(r"([\\{}\[\]*?])")


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` (as Spark names the file of a row), ``file`` (its plain name), ``size, modified`` of each file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else paths)
    # Only names are listed, so few tasks do, however large the files are.
    tasks = 4 * spark.sparkContext.defaultParallelism
    return found.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("path").alias("file"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).coalesce(tasks)


def as_pattern(file: str) -> str:
    """The pattern that finds the file of this plain name and no other."""
    return _GLOB.sub(r"\\\1", file)
