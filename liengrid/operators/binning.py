"""Equal-count bins over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from liengrid.operators.quantiles import grouped_quantiles


def equal_count_bins(df: DataFrame, column: str, bins: int, prefix: str) -> DataFrame:
    """B1: right-closed bins with about equally many rows; ties share a bin.

    Adds {prefix}, {prefix}_low and {prefix}_high. Breaks that coincide are merged, so
    fewer bins may come out; a null value gets no bin. The breaks are one small array,
    known before the rows are scanned.
    """
    fractions = [(i, bins) for i in range(bins + 1)]
    quantiles = grouped_quantiles(df, [], [column], fractions)
    breaks = quantiles.selectExpr(f"array_sort(array_distinct(`{column}`))").scalar()
    value = f"cast(`{column}` as double)"
    number = f"if({value} is null, null, greatest(size(filter(_breaks, b -> b < {value})), 1))"
    found = df.withColumn("_breaks", breaks).selectExpr("*", f"{number} as `{prefix}`")
    return found.selectExpr(
        "* except (_breaks)",
        f"get(_breaks, `{prefix}` - 1) as `{prefix}_low`",
        f"if(`{prefix}` is null, null, get(_breaks, least(`{prefix}`, size(_breaks) - 1))) as `{prefix}_high`",
    )
