"""Helpers that the operators share: whole texts inside tasks, lookups by a hot key, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.session import fresh_folder, shared_root

# Texts are turned into Python objects in pieces of about so many bytes; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 21
# Rows of one key are spread over so many reducers when they look up what belongs to the key.
SALTS = 64


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the folder that ``spark.checkpoint.dir`` names, so that lost executors cost nothing."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """As ``checkpointed``, as a compressed table; for what has very many rows."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def own_rows(docs: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, str]:
    """``row`` (a struct of the carried columns) and, unless it is one of them, ``text``; and the type of ``row``.

    Operators keep a document's own columns in the struct, so that those may have any name.
    """
    columns = [F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row")]
    if "text" not in carry or docs.schema["text"].dataType.simpleString() != "string":
        columns.append(F.col("text").cast("string").alias("text"))
    own = docs.select(*columns)
    return own, own.schema["row"].dataType.simpleString()


def byte_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """First row and UTF-8 texts of consecutive pieces of a batch; a null is an empty text.

    The texts are a column of the batch or a field of its ``row``.
    """
    texts = batch.column(column) if column in batch.schema.names else batch.column("row").field(column)
    start, end, size = 0, 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    while start < len(lengths):
        end, size = start, 0
        while end < len(lengths) and (end == start or size + lengths[end] <= limit):
            size += lengths[end]
            end += 1
        yield start, [text or b"" for text in texts.slice(start, end - start).cast(pa.binary()).to_pylist()]
        start = end


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """As ``byte_chunks``, with texts as strings."""
    for start, texts in byte_chunks(batch, column, limit):
        yield start, [text.decode("utf-8", "replace") for text in texts]


def offsets(counts: np.ndarray) -> np.ndarray:
    """Starts of consecutive pieces, and the end of the last."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges ``[start, start + count)``, one after the other."""
    ends = offsets(counts)
    return np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and code points (a row each) of the words of each length over 0."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) and (width := int(lengths[rows[0]])):
            joined = "".join([words[i] for i in rows.tolist()])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            yield rows, codes.reshape(len(rows), width)


def salted_lookup(rows: DataFrame, key: str, lookup: DataFrame, spread_by: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per key), for keys that may hold any share of the rows.

    The pairs of key and salt that occur are looked up first, at most ``SALTS`` for a key; the rows then meet their
    own pair, so that a hot key is dealt over as many reducers. Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    pairs = salted.select(key, "_salt").distinct().join(lookup, key, how)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")
