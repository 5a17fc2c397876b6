"""Every registered query against its SQL over the smallest tables."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as registry
from tests.compare import differences
from usagemill.operators import clean, stats
from usagemill.plans import oracle
from usagemill.sources import test_tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()
SQL = registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), SQL[name], FOLDER) == []


@pytest.mark.parametrize("missing", ["usagemill.llm.queries", "usagemill.llm", "public_tokenizers", "corpus_pipeline"])
def test_registry_without_the_optional_part(monkeypatch, missing):
    """Queries of the library stay when the subpackage, a library of its own, or the pipeline is not there."""
    for name in [name for name in sys.modules if name == "corpus_pipeline" or name.startswith("usagemill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    found = registry.queries()
    assert set(oracle.ORACLE) <= set(found) and "pipeline" not in found
    assert set(oracle.ORACLE) <= set(registry.oracle_sql())
    if missing != "corpus_pipeline":
        assert not any(name.startswith("op") and name[2].isdigit() for name in found)


def test_summary_has_all_statistics(spark):
    rows = stats.session_duration_summary(clean.clean_sessions(test_tables.usage_sessions(spark, FOLDER))).collect()
    assert [row["summary"] for row in rows] == ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]
    values = {row["summary"]: float(row["SessionDurationMinutes"]) for row in rows}
    assert values["min"] <= values["25%"] <= values["50%"] <= values["75%"] <= values["max"]


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["name", "value", "labels", "timestamp_ms"]
    assert frame.count() > 0
