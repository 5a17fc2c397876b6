from __future__ import annotations

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import fingerprint, linked
from usagemill.llm import queries
from usagemill.llm.tables import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = documents(spark, FOLDER)
    ids = {row["doc_id"] for row in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {row["doc_id"] for row in docs.collect()}
        assert now <= ids
        kept.append(now)
        ids = now
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert {row["doc_id"] for row in corpus_pipeline.run(spark, FOLDER).collect()} == kept[-1]


def test_every_query_has_one_row_per_input_row(spark):
    for name, query in queries.registered().items():
        table, key = {"op8_urls": ("pages", "page_id"), "op11_conversations": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
        assert query(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count(), name


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain_stages(rows, benchmark):
    """What the stages behind the first keep of ``doc_id, text``, after each of them, and the token ids in the end."""
    last = {}
    for doc_id, text in rows:
        last[text or ""] = max(doc_id, last.get(text or "", doc_id))
    rows = [(doc_id, text) for text, doc_id in last.items()]
    yield sorted(doc_id for doc_id, _ in rows)
    roots, least = linked([fingerprint(text) for _, text in rows], 3), {}
    for (doc_id, _), root in zip(rows, roots):
        least[root] = min(doc_id, least.get(root, doc_id))
    rows = [row for row, root in zip(rows, roots) if row[0] == least[root]]
    yield sorted(doc_id for doc_id, _ in rows)
    windows = set()
    for text in benchmark:
        words = plain_words(text)
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(window) for window in windows}
    held = lambda words: any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))
    rows = [row for row in rows if not held(plain_words(row[1]))]
    yield sorted(doc_id for doc_id, _ in rows)
    known = Tokenizer.from_file(queries.vocabulary())
    known.no_truncation()
    known.no_padding()
    coded = [(doc_id, known.encode(text, add_special_tokens=False).ids) for doc_id, text in rows]
    yield sorted((doc_id, ids, known.decode(ids, skip_special_tokens=False)) for doc_id, ids in coded)


def test_later_stages_against_plain_code(spark):
    """Copies, near copies, benchmark text and odd texts through the stages that SQL cannot express as a whole."""
    docs = documents(spark, FOLDER)
    more = docs.filter("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"), "lang", "source", "n_chars")
    odd = spark.createDataFrame([(2000, None, "en", "s", 0), (2001, "", "en", None, 0), (2002, " \n", None, "s", 2), (2003, "word " * 60_000, "en", "s", 1), (2004, "Sigma ΣΑΣ <|endoftext|>", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(more).unionByName(odd).unionByName(docs.filter("doc_id < 5"))
    benchmark = [row["text"] for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = list(plain_stages([(row["doc_id"], row["text"]) for row in docs.collect()], benchmark))
    for (name, stage), kept in zip(corpus_pipeline.STAGES[1:4], want):
        docs = stage(spark, docs, FOLDER)
        assert sorted(row["doc_id"] for row in docs.select("doc_id").collect()) == kept, name
    coded = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert sorted((row["doc_id"], row["ids"], row["decoded"]) for row in coded.collect()) == want[3]
    assert len(want[0]) > len(want[1]) > len(want[2]) > 100


def test_stages_on_awkward_tables(spark):
    """Empty tables, nulls in all columns, rows that repeat and columns with names that stages use themselves."""
    docs = documents(spark, FOLDER).limit(30)
    null = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(5000, None, None, None, None)], docs.schema)
    wide = docs.unionByName(docs).unionByName(null).withColumns({name: F.lit("x") for name in ("row", "key", "score", "hash", "ids", "component_id")})
    for start in (docs.limit(0), wide):
        own, before = start, start.count()
        for name, stage in corpus_pipeline.STAGES[:4]:
            own = stage(spark, own, FOLDER)
            assert own.columns == start.columns and own.count() <= before, name
            before = own.count()
        assert own.select("doc_id", "text").distinct().count() == before
        assert corpus_pipeline.STAGES[4][1](spark, own, FOLDER).count() == before
