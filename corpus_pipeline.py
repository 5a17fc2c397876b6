"""A training corpus from raw documents: clean of insults, copies and benchmark text, and encoded.

Each stage takes all that its predecessor kept, as a table in the shared folder, and applies one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm import bpe, decontaminate, exact, simhash, toxicity
from usagemill.llm.queries import vocabulary
from usagemill.llm.tables import documents, labels
from usagemill.session import fresh_folder


def clean_of_insults(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the machine, fitted on the labels of the documents at hand, does not reject."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest doc_id."""
    return exact.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints within three bits the one of the smallest doc_id."""
    return simhash.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: the token ids of each text, and the text that they decode to."""
    coded = bpe.encoded_report(docs, vocabulary())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", clean_of_insults),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("bpe", encoded),
]

# The first stage is a fitted machine, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
