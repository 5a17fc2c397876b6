from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from usagemill.functions.exposition import label_text, number_text
from usagemill.operators import batches, samples
from usagemill.operators.clean import clean_applications, clean_sessions
from usagemill.sources.reports import text_schema

RUN = samples.Samples("job", 1_700_000_000_500)


def flat(frame):
    return {(r["name"], tuple(sorted(r["labels"].items()))): r["value"] for r in frame.collect()}


def test_schema(spark):
    frame = samples.common_samples(spark.range(3), "printers", RUN)
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in samples.SAMPLE_SCHEMA]


def test_unknown_report_has_the_common_samples(spark):
    found = flat(samples.report_samples(spark.range(3), "printers", RUN))
    labels = (("job_name", "job"), ("report_type", "printers"))
    assert found == {
        (samples.TOTAL_RECORDS, labels): 3.0,
        (samples.LAST_PROCESSED_TIMESTAMP, labels): 1_700_000_000.0,
    }


def test_session_samples_follow_the_columns_present(spark):
    rows = [(" a ", "s1"), ("a", "s2"), ("b", "s3")]
    found = flat(samples.session_samples(clean_sessions(spark.createDataFrame(rows, text_schema(["UserId", "SessionId"]))), RUN))
    assert {name for name, _ in found} == {
        samples.SESSIONS_TOTAL,
        samples.UNIQUE_USERS,
        samples.TOTAL_RECORDS,
        samples.LAST_PROCESSED_TIMESTAMP,
    }
    assert found[samples.UNIQUE_USERS, (("job_name", "job"), ("report_type", "sessions"))] == 2.0


def test_application_samples(spark):
    rows = [(" calc ", "u")] * 3 + [("w" * 70, "u")] * 2 + [(None, "u")]
    clean = clean_applications(spark.createDataFrame(rows, text_schema(["ApplicationName", "UserId"])))
    found = flat(samples.report_samples(clean, "applications", RUN, "2024-01-15"))
    typed = (("job_name", "job"), ("report_type", "applications"))
    assert found[samples.APPLICATION_RECORDS_TOTAL, typed] == 5.0
    assert found[samples.UNIQUE_APPLICATIONS, typed] == 2.0
    top = {labels: value for (name, labels), value in found.items() if name == samples.TOP_APPLICATIONS_USAGE}
    assert top == {
        (("application", "calc"), ("job_name", "job"), ("rank", "1"), ("report_type", "applications")): 3.0,
        (("application", "w" * 50), ("job_name", "job"), ("rank", "2"), ("report_type", "applications")): 2.0,
    }
    processed = (("data_type", samples.USAGE_PREFIX + "applications"), ("job_name", "job"), ("report_date", "2024-01-15"))
    assert found[samples.RECORDS_PROCESSED_TOTAL, processed] == 5.0


def test_samples_without_rows(spark):
    empty = spark.createDataFrame([], "UserId string, SessionDurationMinutes double")
    values = flat(samples.session_samples(empty, RUN))
    assert {v for (name, _), v in values.items() if name != samples.LAST_PROCESSED_TIMESTAMP} == {0.0}
    apps = flat(samples.application_samples(spark.createDataFrame([], "ApplicationName string"), RUN))
    assert samples.TOP_APPLICATIONS_USAGE not in {name for name, _ in apps}


def test_application_totals_and_ranks_share_one_shuffle(spark):
    df = spark.range(1000).select(F.concat(F.lit("a"), F.col("id") % 7).alias("ApplicationName"))
    frame = samples.application_samples(df, RUN)
    frame.collect()
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()


def test_prefixes_can_be_changed(spark):
    run = samples.Samples("job", 1, usage_prefix="use_", job_prefix="etl_")
    profile = samples.profile_samples(spark.range(1), "sessions", run).collect()
    assert {row["name"] for row in profile} == {"etl_column_null_percentage", "etl_data_quality_score"}
    assert profile[0]["labels"]["dataset"] == "use_sessions_reports"


def test_job_name_replaces_a_label_of_that_name(spark):
    labels = F.create_map(F.lit("job_name"), F.lit("old"), F.lit("k"), F.lit("v"))
    row = spark.range(1).select(label_text(samples.with_job_name(labels, F.lit("new"))).alias("t")).first()
    assert row["t"] == 'k="v",job_name="new"'


def test_time_defaults_to_now(spark):
    run = samples.Samples("job")
    row = samples.common_samples(spark.range(1), "x", run).withColumn(
        "age", F.abs(F.unix_millis(F.current_timestamp()) - F.col("timestamp_ms"))
    )
    assert row.agg(F.max("age")).first()[0] < 60_000


def test_line_without_labels_and_with_escapes(spark):
    df = spark.createDataFrame(
        [("m", 1.5, {}, 7), ("n", 2.0, {"k": 'a"b\\c\nd'}, 8)], samples.SAMPLE_SCHEMA
    )
    lines = [row["line"] for row in batches.exposition_lines(df).collect()]
    assert lines == ["m 1.5 7", 'n{k="a\\"b\\\\c\\nd"} 2.0 8']


def test_number_text_is_plain_and_exact(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, -1.0, 1e7, 12345678.9, -2.5e9, 1e15, 9007199254740993.0, 0.5, 1e-3, 0.00012345, 123456789012345.67]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 15) for _ in range(200)]
    df = spark.createDataFrame([(value,) for value in values], "v double")
    for value, text in df.select("v", number_text(F.col("v"))).collect():
        assert float(text) == value
        if 1e-4 <= abs(value) < 1e16:
            assert "e" not in text.lower() and "." in text
    odd = spark.createDataFrame([(1e300,), (1e-9,), (math.inf,), (-math.inf,), (math.nan,), (1e16,)], "v double")
    texts = [row[0] for row in odd.select(number_text(F.col("v"))).collect()]
    assert texts == ["1.0E300", "1.0E-9", "Infinity", "-Infinity", "NaN", "1.0E16"]


@pytest.mark.parametrize("rows, size", [(0, 10), (1, 10), (10, 10), (95, 10), (1000, 7)])
def test_batches_follow_the_order_and_hold_everything(spark, rows, size):
    df = spark.range(rows).select(
        F.xxhash64("id").alias("k"), "id", F.concat(F.lit("line"), F.col("id").cast("string")).alias("line")
    ).repartition(5)
    numbered = batches.number_batches(df, ["k", "id"], size)
    found = sorted((row["position"], row["batch_id"], row["k"], row["id"]) for row in numbered.collect())
    assert [row[0] for row in found] == list(range(rows))
    assert [row[1] for row in found] == [position // size for position in range(rows)]
    assert [row[2:] for row in found] == sorted(row[2:] for row in found)
    bodies = batches.batch_bodies(numbered).collect()
    assert all(1 <= body["samples"] <= size for body in bodies)
    assert all(body["body"].endswith("\n") for body in bodies)
    text = "".join(body["body"] for body in sorted(bodies, key=lambda b: b["batch_id"]))
    assert text.split("\n")[:-1] == [f"line{row[3]}" for row in found]


def test_batches_with_one_value_everywhere(spark):
    """A third of all rows, or all of them, may have the same time; the order goes on with the next column."""
    df = spark.range(5000).select(F.lit(1).alias("k"), "id", F.lit("x").alias("line")).repartition(8)
    sizes = [r["samples"] for r in batches.batch_bodies(batches.number_batches(df, ["k", "id"], 100)).collect()]
    assert sizes == [100] * 50
