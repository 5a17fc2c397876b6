"""Expressions over object keys and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folder prefix of each report type, the scheme of the object store, and the date pattern in a key.
REPORT_FOLDERS = {"sessions": "sessions/", "applications": "applications/"}
OBJECT_ROOT = "s3://"
DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"


def report_type(key: Column) -> Column:
    """Report type by folder prefix, NULL for any other folder."""
    first, *others = REPORT_FOLDERS.items()
    choice = F.when(key.startswith(first[1]), F.lit(first[0]))
    for name, folder in others:
        choice = choice.when(key.startswith(folder), F.lit(name))
    return choice


def report_date(key: Column, default_date: str | None = None) -> Column:
    """First date anywhere in the key; without one ``default_date``, or else today."""
    today = F.date_format(F.current_date(), "yyyy-MM-dd")
    default = today if default_date is None else F.lit(default_date)
    found = F.regexp_extract(key, DATE_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), default)


def folder_of(key: Column) -> Column:
    """The key without its last part and the slash before it."""
    last = F.substring_index(key, "/", -1)
    return F.left(key, F.length(key) - F.length(last) - F.lit(1))


def object_uri(bucket: Column, key: Column, root: str = OBJECT_ROOT) -> Column:
    return F.concat(F.lit(root), bucket, F.lit("/"), key)
