"""Columns and measures given as a mapping from name to SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_sql(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} as `{name}`" for name, sql in columns.items()])


def with_sql(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds or replaces columns; each text sees the columns as they were before."""
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def aggregate_sql(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} as `{name}`") for name, sql in measures.items()])


def names_sql(*names: str) -> dict[str, str]:
    """Columns that are taken over as they are."""
    return {name: name for name in names}
