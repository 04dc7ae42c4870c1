"""Row-by-row comparison of a registered query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("number", float(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float)):
        return ("null", None) if isinstance(value, float) and math.isnan(value) else ("number", float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("date", value.isoformat())
    return ("null", None) if value is None else ("text", str(value))


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(row[i]) for i in order] for row in rows), key=repr)


def difference(df, connection, sql: str) -> str | None:
    """None if both give the same rows and column names, else the first difference."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _sorted_rows(names, result.fetchall())
    actual = _sorted_rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(expected) != len(actual):
        return f"{len(actual)} rows instead of {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if mine != theirs:
            cells = [(n, a, b) for n, a, b in zip(sorted(names), mine, theirs) if a != b]
            return f"different cells {cells} in {mine}"
    return None
