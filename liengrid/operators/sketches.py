"""Mergeable sketches of distinct values, stored per group.

A sketch of a group holds what is needed to count its distinct values, alone or together with other
groups: sketches of area, years or late files are merged without reading the facts again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from liengrid.operators.columns import aggregate_sql, names_sql, select_sql

# A sketch has up to 2^LOG_SIZE registers, whatever it counts: 4 kB at 12.
LOG_SIZE = 12


def relative_error(log_size: int = LOG_SIZE) -> float:
    """Three standard errors of an estimate; groups of up to some hundred values are counted nearly exactly."""
    return 3 * 1.04 / math.sqrt(2**log_size)


def distinct_sketches(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], log_size: int = LOG_SIZE
) -> DataFrame:
    """A5-like table: per group and column a sketch of its values, and whether a null is among them.

    Sketches are built per task before the shuffle, so a group of any size sends one per task.
    """
    measures = {f"{c}_sketch": f"hll_sketch_agg(cast(`{c}` as string), {log_size})" for c in columns}
    measures |= {f"{c}_has_null": f"max(`{c}` is null)" for c in columns}
    return aggregate_sql(df, keys, measures)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, or of several tables stacked: the same columns again."""
    measures = {f"{c}_sketch": f"hll_union_agg(`{c}_sketch`)" for c in columns}
    measures |= {f"{c}_has_null": f"max(`{c}_has_null`)" for c in columns}
    return aggregate_sql(sketches, keys, measures)


def distinct_counts(sketches: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The number of distinct values, where null counts as one value, in the columns num_distinct_*."""
    counts = {f"num_distinct_{c}": f"hll_sketch_estimate(`{c}_sketch`) + if(`{c}_has_null`, 1, 0)" for c in columns}
    return select_sql(sketches, names_sql(*keys) | counts)
