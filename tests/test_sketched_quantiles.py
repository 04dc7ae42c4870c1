"""Quantiles from sketches and a second pass, against those from buckets and from Python."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from liengrid.operators.columns import aggregate_sql
from liengrid.operators.quantiles import bracketed_quantiles, grouped_quantiles, sketch_measures

FRACTIONS = [(1, 2), (1, 10), (1, 1), (0, 1), (2, 3)]


def plain(values, fraction):
    values = sorted(v for v in values if v is not None and v == v)
    if not values:
        return None
    place = Fraction(*fraction) * (len(values) - 1)
    low = values[int(place)]
    high = values[min(int(place) + 1, len(values) - 1)]
    weight = float(place - int(place))
    return low * (1 - weight) + high * weight if weight else low


def table(spark, rows):
    df = spark.createDataFrame(rows, "a string, b int, x double, y double").repartition(5)
    return df, aggregate_sql(df, ["a", "b"], sketch_measures(["x", "y"]) | {"rows": "count(*)"})


def drawn(seed, count):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        a = rng.choice(["hot"] * 8 + ["b", "c", None])
        x = rng.choice([rng.gauss(0, 1e-6), rng.random() * 1e-300, 0.0, -0.0, float(rng.randrange(5)), 1e300])
        y = rng.choice([None, rng.lognormvariate(8, 2), float("nan"), 2500.0])
        rows.append((a, rng.randrange(2), x, y))
    return rows + [("d", 1, None, None), ("e", 1, 5.5, None), ("f", 1, float("inf"), float("-inf"))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_buckets_and_plain(spark, seed):
    rows = drawn(seed, 20_000)
    df, cells = table(spark, rows)
    made = {(r.a, r.b): (r.x, r.y) for r in bracketed_quantiles(df, cells, ["a", "b"], ["x", "y"], FRACTIONS).collect()}
    groups = {}
    for a, b, x, y in rows:
        groups.setdefault((a, b), []).append((x, y))
    assert made.keys() == {k for k, v in groups.items() if any(p is not None for pair in v for p in pair)}
    bucketed = {(r.a, r.b): (r.x, r.y) for r in grouped_quantiles(df, ["a", "b"], ["x", "y"], FRACTIONS).collect()}
    for key, pairs in groups.items():
        if key not in made or key[0] == "f":
            continue
        for i in (0, 1):
            expected = [plain([p[i] for p in pairs], f) for f in FRACTIONS]
            for found in (made[key][i], bucketed[key][i]):
                assert found == (expected if None in expected else pytest.approx(expected, rel=1e-12))


def test_brackets_that_miss_are_done_again(spark):
    rows = [("k", 0, random.Random(i).random(), 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "a string, b int, x double, y double").repartition(3)
    cells = aggregate_sql(df, ["a"], sketch_measures(["x"], size=8))
    made = bracketed_quantiles(df, cells, ["a"], ["x"], [(1, 3)], margin=0.0).first()
    assert made.x[0] == pytest.approx(plain([r[2] for r in rows], (1, 3)), rel=1e-12)


def test_whole_table_and_no_rows(spark):
    df = spark.range(1001).selectExpr("double(id) as x")
    cells = aggregate_sql(df, [], sketch_measures(["x"]))
    assert bracketed_quantiles(df, cells, [], ["x"], [(1, 2), (1, 4)]).first().x == [500.0, 250.0]
    empty = df.where("x < 0")
    assert bracketed_quantiles(empty, aggregate_sql(empty, [], sketch_measures(["x"])), [], ["x"]).count() == 0


def test_second_pass_reads_few_values(spark):
    """The window sorts the values near the wanted rank only, also where all values are near zero."""
    df = spark.range(200_000).selectExpr("'k' as k", "id * 1e-9 as x")
    cells = aggregate_sql(df, ["k"], sketch_measures(["x"]))
    from liengrid.operators.quantiles import SKETCH_MARGIN, _brackets

    b = _brackets(cells, ["k"], ["x"], [(1, 2)], SKETCH_MARGIN).first()
    inside = df.where(f"x between {b._low!r} and {b._high!r}").count()
    assert 1 < inside < 0.05 * 200_000
