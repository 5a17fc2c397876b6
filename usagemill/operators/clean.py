"""Cleaning of session, application and other reports.

Which steps apply is decided from the column names when the plan is built; every step is a filter
or a projection, so a clean report is one narrow pass over its rows with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagemill.functions.cells import cell, minutes_between, parse_number, parse_time, present

# Report columns with a meaning.
SESSION_TIMES = ["SessionStartTime", "SessionEndTime", "ConnectTime", "DisconnectTime"]
USAGE_TIMES = ["UsageDuration", "ApplicationUsageTime", "Duration"]


def _keep_filled(df: DataFrame, names: list[str]) -> DataFrame:
    filled = [cell(name).isNotNull() for name in present(df, names)]
    return df.where(reduce(lambda a, b: a & b, filled)) if filled else df


def _trim(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: F.trim(cell(name)) for name in present(df, names)})


def parse_session_times(df: DataFrame) -> DataFrame:
    return df.withColumns({name: parse_time(cell(name)) for name in present(df, SESSION_TIMES)})


def session_minutes(df: DataFrame) -> DataFrame:
    """Adds ``SessionDurationMinutes`` when the report has both a start and an end."""
    start, end = "SessionStartTime", "SessionEndTime"
    if len(present(df, [start, end])) < 2:
        return df
    return df.withColumn("SessionDurationMinutes", minutes_between(cell(start), cell(end)))


def clean_sessions(df: DataFrame) -> DataFrame:
    """Rows with a user and a session, the user trimmed, times parsed, duration added."""
    kept = _trim(_keep_filled(df, ["UserId", "SessionId"]), ["UserId"])
    return session_minutes(parse_session_times(kept))


def usage_minutes(df: DataFrame) -> DataFrame:
    """Adds ``UsageDurationMinutes`` from the first of the usage columns that the report has."""
    sources = present(df, USAGE_TIMES)
    if not sources:
        return df
    return df.withColumn("UsageDurationMinutes", parse_number(cell(sources[0])))


def clean_applications(df: DataFrame) -> DataFrame:
    """Rows with an application and a user, both trimmed, usage time as a number."""
    names = ["ApplicationName", "UserId"]
    return usage_minutes(_trim(_keep_filled(df, names), names))


def _is_filled(field: T.StructField) -> Column:
    """Not NULL, and not NaN in a column of numbers; empty text is a value."""
    value = cell(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def clean_generic(df: DataFrame, aside: Sequence[str] = ()) -> DataFrame:
    """Rows with at least one value, all text trimmed; columns ``aside`` are no part of the report."""
    fields = [field for field in df.schema.fields if field.name not in aside]
    texts = [field.name for field in fields if isinstance(field.dataType, T.StringType)]
    filled = [_is_filled(field) for field in fields]
    kept = df.where(reduce(lambda a, b: a | b, filled)) if filled else df
    return _trim(kept, texts)


def clean_report(df: DataFrame, report_type: str, aside: Sequence[str] = ()) -> DataFrame:
    """Cleaning by report type; an unknown type gets the generic one. Columns ``aside`` are carried along."""
    by_type = {"sessions": clean_sessions, "applications": clean_applications}
    return by_type[report_type](df) if report_type in by_type else clean_generic(df, aside)


def with_metadata(df: DataFrame, report_type: str, report_date: str) -> DataFrame:
    return df.withColumns(
        {
            "ProcessedAt": F.current_timestamp(),
            "ReportType": F.lit(report_type),
            "ProcessingDate": F.lit(report_date),
        }
    )
