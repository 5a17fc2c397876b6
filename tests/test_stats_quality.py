from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from usagemill.functions.cells import distinct_values, reads_as_nan
from usagemill.operators import quality, stats


def test_distinct_count_takes_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "UserId string")
    assert stats.unique_users(df).first()[0] == 2
    assert df.agg(distinct_values(F.col("UserId"))).first()[0] == 2


def test_stats_without_rows(spark):
    empty = spark.createDataFrame([], "UserId string, SessionDurationMinutes double")
    assert stats.session_duration_stats(empty).first() == (0.0, 0.0, 0.0)
    assert stats.unique_users(empty).first()[0] == 0
    assert stats.total_records(empty).first()[0] == 0


def test_top_applications_break_ties_by_name_and_cut_long_names(spark):
    names = ["b"] * 3 + ["a"] * 3 + ["x" * 60] * 4 + [f"n{i:02}" for i in range(20)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(name,) for name in names], "ApplicationName string")
    rows = stats.top_applications(df).collect()
    assert [row["rank"] for row in rows] == list(range(1, 11))
    assert [tuple(row)[:2] for row in rows[:4]] == [("x" * 50, 4), ("a", 3), ("b", 3), ("n00", 1)]


def test_group_counts_add_up_to_the_rows(spark):
    rng = random.Random(5)
    names = [rng.choice("abcdefg") for _ in range(500)]
    counts = stats.application_counts(spark.createDataFrame([(name,) for name in names], "ApplicationName string"))
    assert {row[0]: row[1] for row in counts.collect()} == {name: names.count(name) for name in set(names)}


def test_top_k_keeps_only_k_rows_per_task(spark, plan_of):
    df = spark.createDataFrame([("a",)], "ApplicationName string")
    plan = plan_of(stats.top_applications(df))
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "partial_count" in plan


def test_missing_cells_by_type(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("NaN", nan, 1, True), ("abc", 1.0, None, None), (None, None, 2, False), (" nan ", 0.0, 3, True)],
        "t string, d double, `i.x` int, b boolean",
    )
    rows = {row["column"]: row["null_pct"] for row in quality.column_null_percentage(df).collect()}
    assert rows == {"t": 75.0, "d": 50.0, "i.x": 25.0, "b": 25.0}
    assert quality.data_quality_score(df).first()[0] == pytest.approx(100 - 175 / 4)


def test_nan_text_is_what_a_cast_takes_for_nan(spark):
    texts = ["NaN", "nan", "nAn", " NaN ", "\tnan\n", "\x00NaN", "+NaN", "-NaN", "+nan", "NaNd", "", "  ", "nan.", "n a n"]
    texts += ["abc", "1.5", "Inf", "-Infinity", "++NaN", "NaN NaN", " nan", "Kan", "0x1p3", "\x7fnan"]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    by_cast = F.coalesce(F.isnan(F.col("t").try_cast("double")), F.lit(False))
    rows = df.select("t", reads_as_nan(F.col("t")).alias("said"), by_cast.alias("cast")).collect()
    assert [row["t"] for row in rows if row["said"] != row["cast"]] == []
    assert sum(row["cast"] for row in rows) == 8


def test_profile_without_rows_or_columns(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert [row["null_pct"] for row in quality.column_null_percentage(empty).collect()] == [0.0, 0.0]
    assert quality.data_quality_score(empty).first()[0] == 100.0
    assert quality.data_quality_score(spark.range(3).select()).first()[0] == 100.0


def test_score_is_a_percentage(spark):
    rng = random.Random(7)
    for _ in range(5):
        rows = [tuple(rng.choice([None, "x", "NaN"]) for _ in range(4)) for _ in range(rng.randint(1, 20))]
        score = quality.data_quality_score(spark.createDataFrame(rows, "a string, b string, c string, d string"))
        assert 0 <= score.first()[0] <= 100


def test_profile_is_one_aggregate(spark, plan_of):
    df = spark.range(10).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(30)])
    plan = plan_of(quality.column_null_percentage(df))
    assert plan.count("Exchange") == 1
    assert plan.count("Range (") == 1
