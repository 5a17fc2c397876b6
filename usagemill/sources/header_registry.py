"""The headers of report files, looked at once in the life of a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.sinks.tables import exists
from usagemill.sources.reports import open_headers

_SCHEMA = "path string, size bigint, modified timestamp, names array<string>"


@dataclass(frozen=True)
class HeaderRegistry:
    """A table of headers by path, size and time of change, in a folder of its own."""

    folder: str

    def known(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self.folder):
            return spark.createDataFrame([], _SCHEMA)
        return spark.read.schema(_SCHEMA).parquet(self.folder)

    def unknown(self, spark: SparkSession, listing: DataFrame) -> DataFrame:
        """The files of a listing that have not been looked at as they are now."""
        return listing.join(self.known(spark), ["path", "size", "modified"], "left_anti")

    def headers(self, spark: SparkSession, listing: DataFrame) -> DataFrame:
        """``path, names`` of the files of ``listing`` (``path, size, modified``) that are not empty.

        Only files that are unknown are opened, by tasks; what they find is appended. Two jobs may look at one file at
        once: they find the same, and one of the rows counts.
        """
        unknown = self.unknown(spark, listing).select("path", "size", "modified")
        opened = open_headers(unknown, ["size", "modified"], empty=True)
        opened.select("path", "size", "modified", "names").write.mode("append").parquet(self.folder)
        one = Window.partitionBy("path", "size", "modified").orderBy(F.size("names"))
        known = self.known(spark).withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_nth")
        return listing.select("path", "size", "modified").join(known, ["path", "size", "modified"]).where("names IS NOT NULL").select("path", "names")
