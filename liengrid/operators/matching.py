"""Left joins where null equals null, and the audit of such joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liengrid.operators.columns import aggregate_sql

KEY = "_key"


def same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> str:
    """Equality of all keys with null equal to null; Spark still plans an equi-join."""
    return " and ".join(f"{left}.`{key}` <=> {right}.`{key}`" for key in keys)


def left_match(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left join on keys; columns present on both sides get the suffix on the right."""
    taken = set(left.columns)
    attributes = [
        f"r.`{c}` as `{c + suffix if c in taken else c}`" for c in right.columns if c not in keys
    ]
    joined = left.alias("l").join(right.alias("r"), F.expr(same_keys(keys)), "left")
    return joined.selectExpr("l.*", *attributes)


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns packed into one struct column, which is never null itself.

    Structs with a null in the same field are equal, so a plain equality of such columns
    follows N1, and a table that is already grouped by the column is not shuffled again.
    """
    packed = ", ".join(f"`{key}`" for key in keys)
    return df.selectExpr(f"* except ({packed})", f"struct({packed}) as {KEY}")


def left_match_first(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    """Left join of two tables from with_key; the key columns come back in front."""
    taken = set(left.columns)
    attributes = [f"r.`{c}` as `{c + suffix if c in taken else c}`" for c in right.columns if c != KEY]
    joined = left.alias("l").join(right.alias("r"), F.expr(f"l.{KEY} = r.{KEY}"), "left")
    return joined.selectExpr(f"l.{KEY}.*", f"l.* except ({KEY})", *attributes)


def match_audit(
    facts: DataFrame, parcels: DataFrame, keys: Sequence[str], kept_keys: Sequence[str]
) -> DataFrame:
    """What a left join on keys and a keep-first on kept_keys would do, without doing them.

    Both sides are counted per key first, so the pairs of a frequent key are never built.
    """
    rows = aggregate_sql(facts, list(dict.fromkeys([*keys, *kept_keys])), {"_rows": "count(*)"})
    found = aggregate_sql(parcels, keys, {"_parcels": "count(*)"})
    per_kept_row = aggregate_sql(
        left_match(rows, found, keys),
        kept_keys,
        {
            "_rows": "sum(_rows)",
            "_matched": "sum(if(_parcels is null, 0, _rows))",
            "_joined": "sum(_rows * coalesce(_parcels, 1))",
        },
    )
    return aggregate_sql(
        per_kept_row,
        [],
        {
            "rows_in": "coalesce(sum(_rows), 0)",
            "rows_matched": "coalesce(sum(_matched), 0)",
            "rows_unmatched": "coalesce(sum(_rows - _matched), 0)",
            "rows_after_join": "coalesce(sum(_joined), 0)",
            "rows_kept": "count(*)",
            "rows_kept_matched": "count_if(_matched > 0)",
        },
    )
