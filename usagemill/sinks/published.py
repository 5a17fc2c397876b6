"""Clean tables whose rows appear a run at a time, together with the record of the files that they came from.

Below the root of a table stand

- ``rows/run=<run>/...``: the rows of a run, each with its ``SourceFile``, partitioned like any clean table;
- ``files/run=<run>``: the manifest, one row for each file that the run took;
- ``state-<name>/run=<run>``: mergeable states of those files (profiles, sketches);
- ``commits``: one line a run, written last and as one file. Rows, files and states without such a line are not seen, so
  a run that dies leaves nothing behind that counts, and the same run may be staged again over its own remains.

A path may be taken more than once: a file that was replaced, or two jobs that ran at the same time. Of the takings of a
path only that of the newest file counts, of equal ones the first that was published, so no file's rows are there twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.session import with_slash
from usagemill.sinks.tables import PARTITION_COLUMNS, exists, partitioning

RUN, SOURCE = "run", "SourceFile"
FILES_SCHEMA = "path string, file string, size bigint, modified timestamp"
COMMIT_SCHEMA = "run string, published_at timestamp, files bigint, rows bigint, replaces array<string>"


@dataclass(frozen=True)
class PublishedTable:
    """``files`` is the plain name by which a file can be read, ``path`` the name that Spark gives its rows."""

    root: str

    def _part(self, name: str) -> str:
        return f"{with_slash(self.root)}{name}"

    def _of_run(self, name: str, run: str) -> str:
        return f"{self._part(name)}/{RUN}={run}"

    # Writing

    def stage_rows(self, rows: DataFrame, run: str) -> None:
        """Writes the rows of a run, with their ``SourceFile``, where no reader sees them yet."""
        writer = rows.write.mode("overwrite").option("compression", "snappy").partitionBy(*partitioning(rows))
        writer.parquet(self._of_run("rows", run))

    def stage_files(self, files: DataFrame, run: str) -> None:
        files.select("path", "file", "size", "modified").write.mode("overwrite").parquet(self._of_run("files", run))

    def stage_state(self, name: str, state: DataFrame, run: str) -> None:
        """``state`` has a ``path`` and what is to be merged over the files that count."""
        state.write.mode("overwrite").parquet(self._of_run(f"state-{name}", run))

    def publish(self, spark: SparkSession, run: str, files: int, rows: int, replaces: list[str] | None = None) -> None:
        """Makes a staged run visible, and the runs that it ``replaces`` invisible, by one file of one line.

        A run that is published already stays as it is.
        """
        if self.is_published(spark, run):
            return
        replaced = F.array(*map(F.lit, replaces or [])).cast("array<string>")
        line = spark.range(0, 1, 1, 1).select(
            F.lit(run).alias("run"),
            F.current_timestamp().alias("published_at"),
            F.lit(files).cast("bigint").alias("files"),
            F.lit(rows).cast("bigint").alias("rows"),
            replaced.alias("replaces"),
        )
        line.write.mode("append").json(self._part("commits"))

    # Reading

    def _read(self, spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
        path = self._part(name)
        if not exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def commits(self, spark: SparkSession) -> DataFrame:
        """One row a published run; the first of any that was published twice."""
        path = self._part("commits")
        lines = spark.read.schema(COMMIT_SCHEMA).json(path) if exists(spark, path) else spark.createDataFrame([], COMMIT_SCHEMA)
        first = F.min_by(F.struct("files", "rows", "replaces"), "published_at")
        found = lines.groupBy("run").agg(F.min("published_at").alias("published_at"), first.alias("said"))
        return found.select("run", "published_at", "said.*")

    def is_published(self, spark: SparkSession, run: str) -> bool:
        return not self.commits(spark).where(F.col("run") == run).isEmpty()

    def live_runs(self, spark: SparkSession) -> DataFrame:
        """``run, published_at`` of the published runs that no published run replaces."""
        commits = self.commits(spark)
        replaced = commits.select(F.explode("replaces").alias("run"))
        return commits.select("run", "published_at").join(replaced, "run", "left_anti")

    def _takings(self, spark: SparkSession) -> DataFrame:
        """Every taking of a file by a live run, with ``nth``: 1 for the one that counts."""
        files = self._read(spark, "files", f"{FILES_SCHEMA}, {RUN} string").join(self.live_runs(spark), RUN)
        best = Window.partitionBy("path").orderBy(F.desc("modified"), "published_at", RUN)
        return files.withColumn("nth", F.row_number().over(best))

    def files(self, spark: SparkSession) -> DataFrame:
        """The manifest: ``path, file, size, modified, run`` of the files that count."""
        return self._takings(spark).where("nth = 1").select("path", "file", "size", "modified", RUN)

    def superseded(self, spark: SparkSession) -> DataFrame:
        """``path, run`` of live takings that do not count."""
        return self._takings(spark).where("nth > 1").select("path", RUN)

    def pending(self, spark: SparkSession, listing: DataFrame) -> DataFrame:
        """The files of a listing that are not in the manifest with this size and time of change."""
        taken = self.files(spark).select("path", "size", "modified")
        return listing.join(taken, ["path", "size", "modified"], "left_anti")

    def _live(self, spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
        """Rows of live runs without those of takings that do not count. Spark prunes the folders of other runs."""
        gone = self.superseded(spark).withColumnRenamed("path", path)
        return rows.join(self.live_runs(spark).select(RUN), RUN).join(gone, [path, RUN], "left_anti")

    def read(self, spark: SparkSession, schema: T.StructType, with_source: bool = False) -> DataFrame:
        """The table with the given columns; with ``with_source`` the ``SourceFile`` and ``run`` of each row too."""
        whole = T.StructType([*schema.fields, T.StructField(SOURCE, T.StringType()), T.StructField(RUN, T.StringType())])
        rows = self._live(spark, self._read(spark, "rows", whole), SOURCE)
        return rows.select(*schema.names, *([SOURCE, RUN] if with_source else []))

    def is_there(self, spark: SparkSession) -> bool:
        return exists(spark, self._part("commits"))

    def read_all(self, spark: SparkSession) -> DataFrame:
        """The table with the columns of all of its runs, as the files have them."""
        found = spark.read.option("mergeSchema", True).parquet(self._part("rows")).schema
        names = [field for field in found.fields if field.name not in (SOURCE, RUN)]
        text = [T.StructField(field.name, T.StringType()) if field.name in PARTITION_COLUMNS else field for field in names]
        return self.read(spark, T.StructType(text))

    def staged(self, spark: SparkSession, schema: T.StructType, run: str) -> DataFrame:
        """The rows of one run, published or not."""
        if not exists(spark, self._of_run("rows", run)):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._of_run("rows", run))

    def staged_state(self, spark: SparkSession, name: str, schema: str, run: str) -> DataFrame:
        """The states of one run, published or not."""
        return spark.read.schema(schema).parquet(self._of_run(f"state-{name}", run))

    def state(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """The states of the files that count; ``schema`` has their columns, ``path`` first."""
        return self._live(spark, self._read(spark, f"state-{name}", f"{schema}, {RUN} string"), "path").drop(RUN)
