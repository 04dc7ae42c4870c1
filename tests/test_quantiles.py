"""Distributed quantiles and bins against a plain computation."""

from __future__ import annotations

import random
import statistics

import pytest

from liengrid.operators.binning import equal_count_bins
from liengrid.operators.quantiles import grouped_medians, grouped_quantiles


def plain_quantile(values, part, whole):
    ordered = sorted(values)
    low, rest = divmod((len(ordered) - 1) * part, whole)
    high = ordered[low + (rest > 0)]
    return ordered[low] * (1 - rest / whole) + high * rest / whole


def sample(seed):
    """Groups of one to many rows, one of them with a third of the table, ties and nulls."""
    random.seed(seed)
    rows = []
    for group in ["hot", "a", "b", "c", "one", None]:
        size = {"hot": 4000, "one": 1}.get(group, random.randint(2, 300))
        for _ in range(size):
            cents = random.choice([random.randint(-500, 500), random.randint(0, 10**9), 1234])
            rows.append((group, cents / 100 if random.random() > 0.02 else None))
    rows += [("empty", None)] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_match_sorting(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "g string, v double").withColumnRenamed("v", "value")
    fractions = [(0, 5), (1, 5), (1, 2), (4, 5), (5, 5)]
    found = {
        r.g: r.value
        for r in grouped_quantiles(df, ["g"], ["value"], fractions).collect()
    }
    groups = {g: [v for k, v in rows if k == g and v is not None] for g, _ in rows}
    expected = {g: [plain_quantile(vs, *f) for f in fractions] for g, vs in groups.items() if vs}
    assert found.keys() == expected.keys()
    for g, values in expected.items():
        assert found[g] == pytest.approx(values, abs=1e-6)


def test_medians_of_several_columns(spark):
    rows = [("a", 1.0, 10.0), ("a", 2.0, None), ("a", 4.0, 30.0), ("a", 5.0, None), ("b", 7.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    medians = grouped_medians(df, ["g"], {"mx": "x", "my": "y"})
    assert {r.g: (r.mx, r.my) for r in medians.collect()} == {"a": (3.0, 20.0), "b": (7.0, None)}


def test_even_count_takes_the_mean_of_the_middle(spark):
    values = [2542.26, 2165.81, 2165.82, 15.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    median = grouped_medians(df.selectExpr("1 as g", "x"), ["g"], {"m": "x"}).first().m
    assert median == statistics.median(values)


def test_bins_are_right_closed_and_ties_share_a_bin(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = equal_count_bins(df, "x", 5, "bin").collect()
    bins = {r.x: (r.bin, r.bin_low, r.bin_high) for r in rows}
    assert bins[1.0] == (1, 1.0, 3.0) and bins[3.0] == (1, 1.0, 3.0)
    assert bins[4.0] == (2, 3.0, 5.0) and bins[11.0] == (5, 9.0, 11.0)
    assert bins[None] == (None, None, None)


def test_equal_breaks_are_merged(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0]], "x double")
    rows = equal_count_bins(df, "x", 5, "bin").collect()
    assert {r.x: r.bin for r in rows} == {1.0: 1, 2.0: 2, 3.0: 2}
    same = spark.createDataFrame([(4.0,)] * 3, "x double")
    assert {(r.bin, r.bin_low, r.bin_high) for r in equal_count_bins(same, "x", 5, "bin").collect()} == {
        (1, 4.0, 4.0)
    }


def test_no_single_task_holds_a_group(spark):
    """Only buckets, values and picked rows are shuffled, each after a partial sum."""
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as x")
    plan = grouped_medians(df, ["g"], {"m": "x"})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_" not in plan
    assert "NestedLoop" not in plan[plan.index("== Physical Plan ==") :]
