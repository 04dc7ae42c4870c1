"""One row per business key, by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_PLACE = "_place"


def nulls_last(name: str) -> str:
    return f"`{name}` asc nulls last"


def locale_order(name: str) -> str:
    """Sort text by locale rules, nulls at the end."""
    return f"collate(`{name}`, 'UNICODE') asc nulls last"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, where null keys equal each other.

    order holds sort items as SQL text, see nulls_last. Spark cuts each input partition
    to one row per key before it shuffles, so a key that holds a large part of the table
    sends one row per input task.
    """
    partition = ", ".join(f"`{key}`" for key in keys)
    place = f"row_number() over (partition by {partition} order by {', '.join(order)}) as {_PLACE}"
    return df.selectExpr("*", place).where(f"{_PLACE} = 1").drop(_PLACE)
