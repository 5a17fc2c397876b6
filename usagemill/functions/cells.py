"""Cell-level expressions: exact names, parsing, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(name: str) -> Column:
    """The column with exactly this name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that ``df`` has, in the given order; case matters, unlike in Spark's resolver."""
    return [name for name in names if name in df.columns]


# Fixed value: how a text with a date begins.
DATED_TEXT = r"\A\s*[+-]?\d{4}"


def parse_time(value: Column) -> Column:
    """Text to timestamp; unreadable text becomes NULL instead of ending the job.

    So does a time without a date, which Spark would take for one of today: what a report says must not depend on
    the day on which it is read.
    """
    return F.when(value.cast("string").rlike(DATED_TEXT), F.try_to_timestamp(value))


def parse_number(value: Column) -> Column:
    return value.try_cast("double")


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from whole second to whole second; negative when the end comes first."""
    return (end.cast("bigint") - start.cast("bigint")) / F.lit(60)


# Fixed value: the texts that a cast to double takes for NaN, with the padding it skips at both ends.
NAN_TEXT = r"\A[\x00-\x20]*([nN][aA][nN]|[+-]NaN)[\x00-\x20]*\z"


def reads_as_nan(text: Column) -> Column:
    """Whether a cast to double would give NaN.

    Matched instead of cast, since a failing cast raises and catches an exception for every plain word.
    """
    return text.rlike(NAN_TEXT)


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN in a numeric column, or text that reads as NaN."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    if isinstance(dtype, T.StringType):
        return value.isNull() | reads_as_nan(value)
    return value.isNull()


def distinct_values(value: Column) -> Column:
    """Aggregate: how many different values, NULL being one of them."""
    has_null = F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))
    return F.count_distinct(value) + has_null
