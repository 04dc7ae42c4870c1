"""Sums of any double, and numbers as the published tables print them."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from liengrid.functions.geometry import EPSG_2804, nesting, over_points
from liengrid.functions.numbers import exact_sum, money_mean, pct, plain_number
from liengrid.operators.keep_first import locale_order
from liengrid.sources import tables


def exact(values):
    """The sum rounded once: decimals as printed below 2^53, whole numbers above."""
    shown = [Fraction(repr(v)) if abs(v) < 2**53 else Fraction(int(v)) for v in values]
    return float(sum(shown))


@pytest.mark.parametrize(
    "values, total",
    [
        ([0.125, 0.125], 0.25),
        ([1e17], 1e17),
        ([1e17, 0.125, 0.125, -1e17], 0.25),
        ([0.1, 0.2], 0.3),
        ([0.1] * 10, 1.0),
        ([-0.75, 0.5], -0.25),
        ([-3.5, 1.25], -2.25),
        ([-0.5, -0.5], -1.0),
        ([5.0, -5.0], 0.0),
        ([1e-9, 1e10, -1e10], 1e-9),
        ([12345678901.255, 0.005], 12345678901.26),
        ([1e300, 1.0], 1e300),
        ([float("inf"), 1.0], float("inf")),
        ([4.5e18, 4.5e18, 4.5e18], 1.35e19),
    ],
)
def test_exact_sum(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "c double")
    assert df.selectExpr(exact_sum("c")).first()[0] == total
    assert df.selectExpr(money_mean("c")).first()[0] == total / len(values)


def test_exact_sum_of_nothing_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5), (2, math.nan), (3, 2.5)], "k int, c double")
    rows = {r.k: r.s for r in df.groupBy("k").agg(F.expr(f"{exact_sum('c')} as s")).collect()}
    assert rows[1] is None and math.isnan(rows[2]) and rows[3] == 2.5


def test_exact_sum_does_not_depend_on_order(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 17) for _ in range(3000)]
    values = [round(v, 3) if abs(v) > 1 else v for v in values]
    expected = exact(values)
    for parts in (1, 7):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "c double").repartition(parts)
        assert df.selectExpr(exact_sum("c")).first()[0] == expected


def test_plain_numbers(evaluate):
    values = [1.994387273e7, 0.0, -0.0, 50100.0, 1683.5900000000001, 1e5, 1e-5, 0.1, -12.50, 100.0, 7.0, 1e20, None, math.nan]
    shown = ["19943872.73", "0", "0", "50100", "1683.5900000000001", "100000", "0.00001", "0.1", "-12.5", "100", "7"]
    assert evaluate(plain_number("c"), values, "double")[:11] == shown
    assert evaluate(plain_number("c"), values, "double")[12] is None
    rng = random.Random(5)
    drawn = [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 18) for _ in range(500)]
    assert [float(t) for t in evaluate(plain_number("c"), drawn, "double")] == drawn
    assert not [t for t in evaluate(plain_number("c"), [round(v, 2) for v in drawn], "double") if "E" in t]


def test_published_shares(spark):
    """Counts and the shares printed for them, ties to the even digit."""
    published = [(13, 72, 18.06), (8, 72, 11.11), (9, 64, 14.06), (7, 64, 10.94), (2, 64, 3.12), (2, 160, 1.25), (1, 160, 0.62), (30, 64, 46.88), (10, 64, 15.62), (11, 64, 17.19), (20, 64, 31.25), (3, 0, None)]
    df = spark.createDataFrame(published, "part int, whole int, shown double")
    assert df.where(f"not ({pct('part', 'whole')} <=> shown)").count() == 0


def test_published_row_comes_out_character_for_character(spark, tmp_path):
    """Four published rows, in the published order of names."""
    header = "area,type,num_properties,sum_lien_amount,median_lien_amount,perc_vacant,auction_year"
    lines = ["Canton Industrial Area,neighborhood,376,2235899.71,1064.58,0,2021", "CARE,neighborhood,892,455680.05,1683.5900000000001,18.06,2021", "Rognel Heights,neighborhood,794,439816,2447.62,3.12,2021", '"Unknown ""x"", y",neighborhood,1,NA,NA,NA,2021']
    rows = [("Rognel Heights", 794, 439816.0, 2447.62, 3.12), ("CARE", 892, 455680.05, 1683.5900000000001, 18.06), ('Unknown "x", y', 1, None, None, None), ("Canton Industrial Area", 376, 2235899.71, 1064.58, 0.0)]
    df = spark.createDataFrame(rows, "area string, num_properties int, sum_lien_amount double, median_lien_amount double, perc_vacant double")
    df = df.selectExpr("area", "'neighborhood' as type", "* except (area)", "2021 as auction_year").repartition(3)
    tables.write_summary_csv(df, str(tmp_path / "s"), [F.expr("collate(area, 'UNICODE')").asc_nulls_last()])
    (part,) = (tmp_path / "s").glob("part-*")
    assert part.read_text() == "\n".join([header, *lines]) + "\n"
    assert [r.area for r in df.createOrReplaceTempView("areas") or spark.sql(f"select area from areas order by {locale_order('area')}").collect()] == [line.split(",")[0] for line in lines[:3]] + ['Unknown "x", y']


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_projection_of_any_nesting_and_back(spark, depth):
    kind = "array<" * depth + "struct<x:double,y:double>" + ">" * depth
    value = {"x": -76.6, "y": 39.3}
    for _ in range(depth):
        value = [value]
    df = spark.createDataFrame([(value,), (None,)], f"g {kind}")
    there = df.selectExpr(f"{EPSG_2804.forward_all('g', df.schema['g'].dataType.simpleString())} as m")
    back = there.selectExpr(f"{over_points('m', depth, EPSG_2804.inverse)} as g").collect()
    point = back[0].g
    for _ in range(depth):
        point = point[0]
    assert point.x == pytest.approx(-76.6, abs=1e-11) and point.y == pytest.approx(39.3, abs=1e-11)
    assert back[1].g is None and nesting(kind) == depth


def test_inverse_is_within_a_millimetre(spark):
    points = spark.range(400).selectExpr("-79.5D + id % 20 * 0.25D as lon", "37.8D + id div 20 * 0.1D as lat")
    there = points.selectExpr("lon", "lat", f"{EPSG_2804.forward('lon', 'lat')} as m")
    back = there.selectExpr("lon", "lat", f"{EPSG_2804.inverse('m.x', 'm.y')} as p")
    worst = back.selectExpr("max(abs(p.x - lon) + abs(p.y - lat))").first()[0]
    assert worst * 111_000 < 0.001


def test_points_must_be_structs():
    with pytest.raises(ValueError, match="structs"):
        nesting("array<double>")
