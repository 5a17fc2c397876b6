"""Row-by-row comparison of a Spark result with SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and not isinstance(value, bool):
        return (1, "nan") if math.isnan(value) else (1, repr(round(value, 6) + 0.0))
    return (2, str(value))


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# SQL type names of the two engines that stand for the same type.
TYPE_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}


def differences(frame, sql: str, folder: str) -> list[str]:
    found = []
    connection = connect(folder)
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    other = {row[0]: row[1] for row in described}
    types = {name: TYPE_NAMES.get(kind, kind) for name, kind in frame.dtypes}
    if types != other:
        found.append(f"columns: {types} / {other}")
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = _rows(names, cursor.fetchall())
    actual = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if len(expected) != len(actual):
        found.append(f"rows: {len(actual)} / {len(expected)}")
    found += [f"{a} / {b}" for a, b in zip(actual, expected) if a != b][:3]
    return found
