from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from usagemill.operators import clean
from usagemill.sources.reports import text_schema


def frame(spark, columns, *rows):
    return spark.createDataFrame(list(rows), text_schema(columns))


SESSION = ["UserId", "SessionId", "SessionStartTime", "SessionEndTime"]


@pytest.mark.parametrize(
    "start, end, minutes",
    [
        ("2024-01-15 10:00:00", "2024-01-15 10:30:30.900", 30.5),
        ("2024-01-15T10:00:00Z", "2024-01-15T10:30:30.900Z", 30.5),
        ("2024-01-15 09:00:00", "2024-01-15 08:59:00", -1.0),
        ("2024-01-15", "2024-01-16", 1440.0),
        ("1969-12-31 23:59:59.5", "1970-01-01 00:00:59", 1.0),
        ("bad", "2024-01-15 10:00:00", None),
        ("2024-01-15 10:00:00", None, None),
        ("10:00", "10:30", None),
        ("T10:00:00", " 2024", None),
        (" 2024-01-15 10:00", "2024-01-15T10:05 ", 5.0),
    ],
)
def test_session_minutes(spark, start, end, minutes):
    row = clean.clean_sessions(frame(spark, SESSION, ("alice", "s1", start, end))).first()
    assert row["SessionDurationMinutes"] == minutes


def test_sessions_need_a_user_and_a_session(spark):
    rows = [
        (" alice ", " s1 ", None, None),
        (None, "s2", None, None),
        ("bob", None, None, None),
        ("  ", "s4", None, None),
    ]
    kept = clean.clean_sessions(frame(spark, SESSION, *rows)).collect()
    assert [(row["UserId"], row["SessionId"]) for row in kept] == [("alice", " s1 "), ("", "s4")]


def test_all_session_times_are_parsed(spark):
    columns = ["ConnectTime", "DisconnectTime", "Other"]
    row = clean.clean_sessions(frame(spark, columns, ("2024-01-15 10:00:00", "n/a", "2024-01-15"))).first()
    assert row["ConnectTime"] == dt.datetime(2024, 1, 15, 10)
    assert row["DisconnectTime"] is None
    assert row["Other"] == "2024-01-15"
    assert "SessionDurationMinutes" not in row.asDict()


def test_names_match_exactly(spark):
    columns = ["userid", "SESSIONID"]
    kept = clean.clean_sessions(frame(spark, columns, (" a ", None), (None, "s"))).collect()
    assert [tuple(row) for row in kept] == [(" a ", None), (None, "s")]


@pytest.mark.parametrize(
    "columns, cells, minutes",
    [
        (["UsageDuration", "Duration"], (None, "5"), None),
        (["Duration", "ApplicationUsageTime"], ("5", "7"), 7.0),
        (["Duration"], ("12.5", ), 12.5),
        (["Duration"], ("bad", ), None),
    ],
)
def test_usage_minutes_take_the_first_column_present(spark, columns, cells, minutes):
    assert clean.clean_applications(frame(spark, columns, cells)).first()["UsageDurationMinutes"] == minutes


def test_no_usage_column(spark):
    assert clean.clean_applications(frame(spark, ["ApplicationName"], (" calc ",))).collect() == [("calc",)]


def test_generic_keeps_rows_with_any_value(spark):
    df = spark.createDataFrame([(" a ", None, 1), (None, None, None), (None, "", None)], "`a.b` string, c string, n int")
    kept = clean.clean_report(df, "printers").collect()
    assert [tuple(row) for row in kept] == [("a", None, 1), (None, "", None)]


def test_metadata(spark):
    df = clean.with_metadata(spark.range(1), "sessions", "2024-01-15")
    assert df.dtypes == [
        ("id", "bigint"),
        ("ProcessedAt", "timestamp"),
        ("ReportType", "string"),
        ("ProcessingDate", "string"),
    ]
    assert df.where(F.col("ProcessedAt").isNull()).count() == 0


def test_cleaning_needs_no_shuffle(spark, plan_of):
    for report_type in ("sessions", "applications", "printers"):
        df = frame(spark, SESSION + ["ApplicationName"], (None,) * 5)
        assert "Exchange" not in plan_of(clean.clean_report(df, report_type))
