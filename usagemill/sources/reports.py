"""CSV report readers. All cells are text; typing is the work of the cleaning step."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.functions.cells import cell
from usagemill.session import fresh_folder
from usagemill.sources.listing import list_files
from usagemill.sources.stores import store_of

# The format of report files with a header.
CSV_FORMAT = {
    "sep": ",",
    "quote": '"',
    "escape": "\\",
    "ignoreLeadingWhiteSpace": True,
    "ignoreTrailingWhiteSpace": True,
}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


# A quoted cell, up to which a separator is part of the text.
QUOTED_CELL = r'(^|,)([ \t]*)"(\\.|[^"\\])*"'


def count_cells(line: Column) -> Column:
    """How many cells a line of text has; quoted cells count as one."""
    return F.size(F.split(F.regexp_replace(line, QUOTED_CELL, "$1"), ","))


def _with_source(cells: DataFrame, source: str | None) -> DataFrame:
    """With the file of each row, as Spark names it, in a column ``source``."""
    return cells if source is None else cells.select("*", F.col("_metadata.file_path").alias(source))


def read_headerless(spark: SparkSession, paths: str | list[str], source: str | None = None) -> DataFrame:
    """Files without a header: columns ``_c0, _c1, ...``; only the separator is set, cells keep their spaces.

    Spark would take the number of columns from the first line of one file and drop what others have more. So the
    lines are read once for the widest, by an aggregate, and all files are read as wide as that.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(as_list(paths))
    widest = lines.agg(F.max(count_cells(F.col("value")))).first()[0] or 0
    reader = spark.read.options(sep=",", header=False, recursiveFileLookup=True)
    cells = reader.schema(text_schema([f"_c{i}" for i in range(widest)])).csv(as_list(paths))
    return _with_source(cells, source)


def column_names(header: str) -> list[str]:
    """The column names of a header line. A blank name becomes ``_c`` and its place; a repeated one gets its place."""
    cells = next(csv.reader([header], quotechar=CSV_FORMAT["quote"], escapechar=CSV_FORMAT["escape"], skipinitialspace=True))
    names = [cell.strip() or f"_c{i}" for i, cell in enumerate(cells)]
    return [f"{name}{i}" if names.count(name) > 1 else name for i, name in enumerate(names)]


def open_headers(listed: DataFrame, others: Sequence[str] = (), empty: bool = False) -> DataFrame:
    """``path, names`` of each file of ``listed`` and the columns ``others``; files without a filled line only if ``empty``.

    Tasks open the files and read up to the first filled line.
    """

    def first_lines(batches: Iterator) -> Iterator:
        import io

        def first_line(path: str) -> str | None:
            files, name = store_of(path)
            with files.open_input_stream(name) as stream:
                filled = (line for line in io.BufferedReader(stream, 65536) if line.strip())
                line = next(filled, None)
                return None if line is None else line.decode("utf-8-sig", "replace").rstrip("\r\n")

        for batch in batches:
            lines = [first_line(path) for path in batch["path"]]
            yield batch.assign(names=[None if line is None else column_names(line) for line in lines])

    rows = listed.select("path", *others)
    shape = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    found = rows.mapInPandas(first_lines, f"{shape}, names array<string>")
    return found if empty else found.where(F.col("names").isNotNull())


def file_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, names`` of every non-empty file."""
    return open_headers(list_files(spark, paths))


def read_checked(
    spark: SparkSession, paths: str | list[str], columns: list[str], rescued: str | None = None, source: str | None = None
) -> DataFrame:
    """Files that must all have the given header; the reader compares each file's own, and another one fails.

    This needs no look at the files before the scan.
    """
    reader = spark.read.options(**CSV_FORMAT, header=True, enforceSchema=False, recursiveFileLookup=True)
    return _with_rescued(reader, paths, columns, rescued, source)


def _with_rescued(
    reader: DataFrameReader, paths: str | list[str], columns: list[str], rescued: str | None, source: str | None
) -> DataFrame:
    if rescued is None:
        return _with_source(reader.schema(text_schema(columns)).csv(as_list(paths)), source)
    reader = reader.option("columnNameOfCorruptRecord", rescued).schema(text_schema([*columns, rescued]))
    cells = _with_source(reader.csv(as_list(paths)), source)
    return cells.withColumn(rescued, F.when(_filled_cells(cell(rescued)) > len(columns), cell(rescued)))


def read_alike(
    spark: SparkSession, paths: str | list[str], columns: list[str], rescued: str | None, source: str | None = None
) -> DataFrame:
    """Files that are known to have one header: a plain scan, pruned to the columns that are asked for."""
    reader = spark.read.options(**CSV_FORMAT, header=True, recursiveFileLookup=True)
    return _with_rescued(reader, paths, columns, rescued, source)


def _filled_cells(line: Column) -> Column:
    """Cells up to the last one that is not blank."""
    return count_cells(F.regexp_replace(line, r"[,\s]+\z", ""))


# The header table of the files is broadcast up to this many characters of paths and positions; beyond, rows and
# headers are shuffled by path, and adaptive execution splits the rows of large files.
BROADCAST_CHARACTERS = 32_000_000


def read_by_name(
    spark: SparkSession, paths: str | list[str], headers: DataFrame, rescued: str | None, source: str | None = None
) -> DataFrame:
    """One scan of files with several headers, each cell taken from where the header of its file has the column.

    Spark binds the cells of several files by position, so the scan knows places only, as many as the widest header
    has. ``headers`` comes from a written table; the driver sees column names and three numbers.
    """
    first_seen = headers.select("path", F.posexplode("names").alias("at", "name"))
    columns = [
        row["name"]
        for row in first_seen.groupBy("name").agg(F.min(F.struct("path", "at")).alias("first")).orderBy("first").collect()
    ]
    if len({name.lower() for name in columns}) < len(columns) and spark.conf.get("spark.sql.caseSensitive") != "true":
        raise ValueError("names that differ in case only are different columns: set spark.sql.caseSensitive to true")
    width, characters = headers.agg(
        F.max(F.size("names")), F.sum(F.length("path") + F.lit(4 * len(columns)))
    ).first()
    places = F.transform(F.array(*map(F.lit, columns)), lambda name: F.array_position("names", name).cast("int") - 1)
    placed = headers.select("path", places.alias("places"), F.size("names").alias("width"))
    line = "_line"
    reader = spark.read.options(**CSV_FORMAT, header=True, recursiveFileLookup=True)
    reader = reader.option("columnNameOfCorruptRecord", line)
    positions = [f"_c{i}" for i in range(width)]
    schema = text_schema(positions if rescued is None else [*positions, line])
    scan = reader.schema(schema).csv(as_list(paths)).select(
        F.array(*positions).alias("cells"),
        F.lit(None).cast("string").alias(line) if rescued is None else F.col(line),
        F.col("_metadata.file_path").alias("path"),
    )
    rows = scan.join(F.broadcast(placed) if characters <= BROADCAST_CHARACTERS else placed, "path")
    cells = [F.get("cells", F.get("places", F.lit(i))).alias(name) for i, name in enumerate(columns)]
    if rescued is not None:
        beyond = F.exists(F.slice("cells", F.col("width") + 1, F.lit(width)), lambda value: value.isNotNull())
        longer = _filled_cells(F.col(line)) > F.col("width")
        text = F.coalesce(F.col(line), F.array_join("cells", ",", ""))
        cells.append(F.when(beyond | longer, text).alias(rescued))
    if source is not None:
        cells.append(F.col("path").alias(source))
    return rows.select(*cells)


def read_reports(
    spark: SparkSession,
    paths: str | list[str],
    header: bool = True,
    columns: list[str] | None = None,
    rescued: str | None = None,
    source: str | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """All report files below the given folders, their columns bound by exact name.

    A column that a file lacks is NULL in its rows. Where the header is known, ``columns`` saves the look at the files
    and makes any other header an error. A row may have more cells than the header of its file: the cells that have
    no name are in no column, and with ``rescued`` a column of that name holds the whole line of each such row (NULL in
    all others). Files without a header are as wide as their widest line, so that they have no such rows. With
    ``source`` a column of that name has the file of each row. ``headers`` has ``path, names`` of these files, if they
    have been looked at before (``header_registry.py``).
    """
    if not header:
        rows = read_headerless(spark, paths, source)
        return rows if rescued is None else rows.withColumn(rescued, F.lit(None).cast("string"))
    if columns:
        return read_checked(spark, paths, columns, rescued, source)
    if headers is None:
        folder = fresh_folder(spark, "headers")
        file_headers(spark, paths).write.parquet(folder)
        headers = spark.read.schema("path string, names array<string>").parquet(folder)
    kinds = headers.select("names").distinct().limit(2).collect()
    if not kinds:
        empty = spark.read.options(**CSV_FORMAT, header=True, recursiveFileLookup=True).csv(as_list(paths))
        return _with_source(empty, source)
    if len(kinds) == 1 and len({name.lower() for name in kinds[0]["names"]}) == len(kinds[0]["names"]):
        return read_alike(spark, paths, kinds[0]["names"], rescued, source)
    return read_by_name(spark, paths, headers, rescued, source)
