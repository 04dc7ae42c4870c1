"""Exact quantiles per group that no single task has to hold.

Spark's median and percentile keep every distinct value of a group in one buffer. Here
the values are counted in narrow ordered buckets first, a running count finds the one
or two buckets that hold the wanted positions, and only the values of those buckets are
looked at one by one. A bucket spans a fixed ratio of values, so a group of any number
of rows has a bounded number of buckets, and money in cents has a bounded number of
distinct values per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liengrid.operators.columns import aggregate_sql, names_sql, select_sql
from liengrid.sources.tables import stage

BUCKETS_PER_E_FOLD = 1000
MEDIAN = (1, 2)

# A whole number that never falls as the value rises, in steps of 0.1 percent for every size of number:
# the least double above 0 has a logarithm of about -745. Infinity has the bucket after the largest number.
_STEPS = f"floor(least(ln(abs(_value)), 710) * {BUCKETS_PER_E_FOLD}) + {746 * BUCKETS_PER_E_FOLD}"
_BUCKET = f"if(_value = 0, 0, cast(sign(_value) * ({_STEPS}) as bigint))"

# Sketches: items kept at the top level, and the share of ranks by which a bracket is wider than its quantile on
# either side; about six standard errors of a sketch of this size.
SKETCH_SIZE, SKETCH_MARGIN = 1024, 0.012


def _position(fraction: tuple[int, int]) -> tuple[str, str, str]:
    """Lower and upper 0-based rank of a quantile and the weight of the upper one.

    Whole-number arithmetic, so that a quantile that falls on a row is that row.
    """
    part, whole = fraction
    steps = f"((_total - 1) * {part})"
    low = f"({steps} div {whole})"
    return low, f"({low} + if({steps} % {whole} > 0, 1, 0))", f"({steps} % {whole} / {whole}D)"


def _holds(position: str) -> str:
    return f"(_before <= {position} and {position} < _before + _rows)"


def _quantile(column: str, fraction: tuple[int, int]) -> str:
    mine = f"_column = '{column}'"
    low, high, weight = _position(fraction)
    share = f"max(if({mine}, {weight}, null))"
    at = lambda position: f"max(if({mine} and {_holds(position)}, _value, null))"
    return f"({at(low)} * (1 - {share}) + {at(high)} * {share})"


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    fractions: Sequence[tuple[int, int]] = (MEDIAN,),
) -> DataFrame:
    """Exact interpolated quantiles of several columns, nulls skipped.

    Returns keys plus, per column, an array with one value per fraction (part, whole).
    A group whose values are all null has no row. Equal values are counted before the first
    shuffle; how the wanted buckets are joined is left to Spark's own size check.
    """
    group = [*keys, "_column"]
    by_group = ", ".join(f"`{name}`" for name in group)
    values = (
        select_sql(df, names_sql(*keys) | {c: f"cast(`{c}` as double)" for c in columns})
        .unpivot(list(keys), list(columns), "_column", "_value")
        .where("_value is not null and not isnan(_value)")
    )
    counted = aggregate_sql(values, [*group, "_value"], {"_rows": "count(*)"})
    values = counted.selectExpr("*", f"{_BUCKET} as _bucket")

    buckets = aggregate_sql(values, [*group, "_bucket"], {"_rows": "sum(_rows)"})
    up_to_here = f"over (partition by {by_group} order by _bucket rows unbounded preceding)"
    positions = {p for fraction in fractions for p in _position(fraction)[:2]}
    holds_any = " or ".join(_holds(position) for position in sorted(positions))
    wanted = (
        buckets.selectExpr(
            *group,
            "_bucket",
            "_rows",
            f"sum(_rows) {up_to_here} - _rows as _before",
            f"sum(_rows) over (partition by {by_group}) as _total",
        )
        .where(holds_any)
        .drop("_rows")
    )

    same = [f"v.`{k}` <=> w.`{k}`" for k in keys] + ["v._column = w._column", "v._bucket = w._bucket"]
    candidates = values.alias("v").join(wanted.alias("w"), F.expr(" and ".join(same)))
    counted = aggregate_sql(
        candidates.selectExpr("v.*", "w._before", "w._total"),
        [*group, "_bucket", "_value", "_before", "_total"],
        {"_rows": "sum(_rows)"},
    )
    in_bucket = f"over (partition by {by_group}, _bucket order by _value rows unbounded preceding)"
    ranked = counted.selectExpr(
        *group, "_value", "_rows", "_total", f"_before + sum(_rows) {in_bucket} - _rows as _before"
    ).where(holds_any)
    return aggregate_sql(
        ranked, keys, {c: f"array({', '.join(_quantile(c, f) for f in fractions)})" for c in columns}
    )


def grouped_medians(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Exact medians; columns maps an output name to an input column."""
    quantiles = grouped_quantiles(df, keys, list(columns.values()), (MEDIAN,))
    return select_sql(quantiles, names_sql(*keys) | {name: f"`{c}`[0]" for name, c in columns.items()})


def _sketch(column: str) -> str:
    return f"_{column}_kll"


def sketch_measures(columns: Sequence[str], size: int = SKETCH_SIZE) -> dict[str, str]:
    """Measures for bracketed_quantiles, to be taken in the same pass as other measures of the groups.

    Each column gets a mergeable sketch of its values, of bounded size, and the number of them.
    """
    measures = {}
    for c in columns:
        value = f"cast(`{c}` as double)"
        known = f"if(isnan({value}), null, {value})"
        measures |= {_sketch(c): f"kll_sketch_agg_double({known}, {size})", f"{_sketch(c)}_n": f"count({known})"}
    return measures


def _brackets(
    cells: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Sequence[tuple[int, int]], margin: float
) -> DataFrame:
    """For each group, column and fraction the values between which the quantile lies, and the number of values."""

    def ends(column: str, at: int, fraction: tuple[int, int]) -> str:
        share = fraction[0] / fraction[1]
        low, high = (
            f"kll_sketch_get_quantile_double({_sketch(column)}, {rank!r}D)"
            for rank in (max(0.0, share - margin), min(1.0, share + margin))
        )
        return f"""if({_sketch(column)}_n > 0, named_struct('_column', '{column}', '_at', {at}, '_low', {low}, '_high', {high},
            '_total', {_sketch(column)}_n), null)"""

    every = ", ".join(ends(c, at, f) for c in columns for at, f in enumerate(fractions))
    listed = cells.selectExpr(*[f"`{k}`" for k in keys], f"explode(filter(array({every}), e -> e is not null)) as _bracket")
    return listed.selectExpr(*[f"`{k}`" for k in keys], "_bracket.*")


def bracketed_quantiles(
    df: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    fractions: Sequence[tuple[int, int]] = (MEDIAN,),
    margin: float = SKETCH_MARGIN,
) -> DataFrame:
    """The same as grouped_quantiles, from sketches that an earlier pass over df left in cells.

    cells has the keys and sketch_measures of the groups wanted; groups that are not in it have no row. A
    sketch brackets each wanted rank; df is read once more, values below a bracket are only counted, those in it
    are counted one by one, the others dropped. A bracket is right with overwhelming probability, not with
    certainty: a group whose rank lies outside is found and done by grouped_quantiles, so results are exact.
    """
    group = [*keys, "_column", "_at"]
    brackets = _brackets(cells, keys, columns, fractions, margin)
    values = (
        select_sql(df, names_sql(*keys) | {c: f"cast(`{c}` as double)" for c in columns})
        .unpivot(list(keys), list(columns), "_column", "_value")
        .where("_value is not null and not isnan(_value)")
    )
    same = [f"_v.`{k}` <=> _b.`{k}`" for k in keys] + ["_v._column = _b._column", "_v._value <= _b._high"]
    near = values.alias("_v").join(brackets.alias("_b"), F.expr(" and ".join(same)))
    near = near.selectExpr(*[f"_b.`{c}`" for c in group], "_b._total", "if(_value < _low, null, _value) as _value")
    counted = aggregate_sql(near, [*group, "_total", "_value"], {"_rows": "count(*)"})
    by_group = ", ".join(f"`{name}`" for name in group)
    up_to_here = f"over (partition by {by_group} order by _value nulls first rows unbounded preceding)"
    ranked = counted.selectExpr("*", f"sum(_rows) {up_to_here} - _rows as _before").where("_value is not null")

    def one(column: str, at: int, fraction: tuple[int, int]) -> str:
        mine = f"_column = '{column}' and _at = {at}"
        low, high, weight = _position(fraction)
        share = f"max(if({mine}, {weight}, null))"
        value = lambda position: f"max(if({mine} and {_holds(position)}, _value, null))"
        return f"({value(low)} * (1 - {share}) + {value(high)} * {share})"

    found = aggregate_sql(
        ranked, keys, {c: f"array({', '.join(one(c, at, f) for at, f in enumerate(fractions))})" for c in columns}
    )
    totals = {f"{_sketch(c)}_n": f"{_sketch(c)}_n" for c in columns}
    known = select_sql(cells, names_sql(*keys) | totals).where(" or ".join(f"{n} > 0" for n in totals))
    same = [f"_k.`{k}` <=> _f.`{k}`" for k in keys]
    nothing = f"array({', '.join(['cast(null as double)'] * len(fractions))})"
    joined = known.alias("_k").join(found.alias("_f"), F.expr(" and ".join(same or ["true"])), "left")
    right = [f"({_sketch(c)}_n = 0 or not exists(coalesce(_f.`{c}`, {nothing}), q -> q is null))" for c in columns]
    made = stage(
        joined.selectExpr(
            *[f"_k.`{k}`" for k in keys],
            *[f"coalesce(_f.`{c}`, {nothing}) as `{c}`" for c in columns],
            f"not ({' and '.join(right)}) as _missed",
        )
    )
    missed = made.where("_missed")
    if missed.isEmpty():
        return made.drop("_missed")
    again = [f"_d.`{k}` <=> _m.`{k}`" for k in keys]
    rows = df.alias("_d").join(missed.alias("_m"), F.expr(" and ".join(again or ["true"])), "left_semi")
    return made.where("not _missed").drop("_missed").unionByName(grouped_quantiles(rows, keys, columns, fractions))


def bracketed_medians(
    df: DataFrame, cells: DataFrame, keys: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """A8 from sketches; columns maps an output name to an input column."""
    quantiles = bracketed_quantiles(df, cells, keys, list(columns.values()), (MEDIAN,))
    return select_sql(quantiles, names_sql(*keys) | {name: f"`{c}`[0]" for name, c in columns.items()})
