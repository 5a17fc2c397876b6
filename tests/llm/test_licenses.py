from __future__ import annotations

import hashlib
import re
import textwrap

from pyspark.sql import functions as F

from usagemill.llm import licenses
from usagemill.llm.tables import documents


def test_scan(spark, awkward, empty):
    texts = ["LICENSED under the apache licence -- version 2.0", "Copyright 2020 A\nLicensed under the MIT License.\n(c) B", "no", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    known = licenses.known_licenses(spark)
    found = {row["doc_id"]: row["license"] for row in licenses.scan(docs, known).collect()}
    assert found == {0: "apache-2.0", 1: "mit", 2: None, 3: None, 4: None}
    assert licenses.scan(awkward, known).count() == awkward.count()
    assert licenses.scan(empty, known).count() == 0


def test_runs_of_lines(spark):
    texts = {path.stem: path.read_text() for path in licenses.TEXTS.glob("*.txt")}
    flat = {name: " ".join(text.split()) for name, text in texts.items()}
    wrapped = {name: "\r\n".join(textwrap.wrap(text, 31, break_on_hyphens=False)) for name, text in flat.items()}
    cases = [(f"Some prose.\n\n{text}", name.split("~")[0]) for name, text in texts.items()]
    cases += [(f"# {text}\n\nMore prose.", name.split("~")[0]) for name, text in wrapped.items() if name in ("mit", "bsd-3-clause", "isc", "unlicense")]
    cases += [
        ("Prose.\nReleased under the MIT License.", "mit"),
        ("Prose.\nLicensed under CC BY-NC 4.0.\nMore.\nReleased under the MIT License.", "mit"),
        ("MIT License\n\nCopyright (c) 2020 A\n\n" + flat["mit"], "mit"),
        ("Not released under the MIT License.", None),
        ("Released under the MIT License. Or not.", None),
        (texts["mit"].replace("WITHOUT WARRANTY", "WITH A WARRANTY"), None),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id int, text string")
    rows = {row["doc_id"]: row for row in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [(cases[i][0][:80], rows[i]["license"]) for i in sorted(rows)] == [(text[:80], name) for text, name in cases]
    both = next(rows[i]["licenses"] for i, (text, _) in enumerate(cases) if "CC BY-NC" in text)
    assert both == ["cc-by-nc-4.0", "mit"]


def test_known_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 50000 + "\nLicensed under CC BY-NC 4.0."), (2, "only word")], "doc_id int, text string")
    few = spark.createDataFrame([("one", "word"), ("none", "--"), ("two", "only word"), ("a", "Only, WORD!")], "license string, text string")
    known = licenses.known_licenses(spark)
    assert {row["doc_id"]: row["license"] for row in licenses.scan(docs, known).collect()} == {1: "cc-by-nc-4.0", 2: None}
    assert {row["doc_id"]: row["license"] for row in licenses.scan(docs, few).collect()} == {1: None, 2: "a"}
    assert licenses.scan(docs, known.limit(0)).filter("license IS NULL AND size(licenses) = 0").count() == 2


def plain_lines(text):
    out = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n"))
    for spelling, form in licenses.SPELLINGS:
        out = out.replace(spelling, form)
    out = re.sub(licenses.COPYRIGHT, "\n", out)
    lines = [" ".join(re.findall("[a-z0-9]+", line)) for line in out.split("\n")]
    return [line for line in lines if line]


def test_all_runs_of_lines(spark):
    """All documents, licences among prose and repeated rows, against every run of lines looked up one by one."""
    known = licenses.known_licenses(spark)
    forms = {}
    for row in known.collect():
        form = " ".join(plain_lines(row["text"]))
        forms[form] = min(row["license"], forms.get(form, row["license"]))
    longest = max(map(len, forms))
    texts = {path.stem: path.read_text() for path in licenses.TEXTS.glob("*.txt")}
    made = [f"Prose here.\n{texts['mit']}\nMore\n{texts['isc']}", texts["gpl-3.0"] * 2, "Released under the MIT License.\n" * 3, "© x\n" + texts["bsd-3-clause"]]
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i // 2, text) for i, text in enumerate(made + made)], "doc_id bigint, text string"))
    got = sorted((row["doc_id"], row["license"] or "", row["licenses"], row["canonical_sha256"]) for row in licenses.scan(docs.withColumn("key", F.lit(1)), known).collect())
    want = []
    for row in docs.collect():
        lines, hits = plain_lines(row["text"]), set()
        for i in range(len(lines)):
            run = ""
            for line in lines[i:]:
                run = f"{run} {line}" if run else line
                if len(run) > longest:
                    break
                if run in forms:
                    hits.add((-len(run), forms[run]))
        names = [name for _, name in sorted(hits)]
        digest = hashlib.sha256(" ".join(lines).encode()).hexdigest()
        want.append((row["doc_id"], names[0] if names else "", sorted(set(names)), digest))
    assert got == sorted(want)
    assert sum(1 for _, name, _, _ in got if name) > 30
