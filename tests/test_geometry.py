"""Centroids and the projection against known values."""

from __future__ import annotations

import math

import pytest

from liengrid.functions.geometry import EPSG_2804, LambertConic, centroid
from liengrid.plans.match import with_centroid

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
FAR = ring((10, 0), (12, 0), (12, 2), (10, 2), (10, 0))


@pytest.mark.parametrize(
    "polygons, expected",
    [
        ([[SQUARE]], (2, 2)),
        ([[SQUARE[::-1]]], (2, 2)),
        ([[ring((0, 0), (6, 0), (0, 3), (0, 0))]], (2, 1)),
        ([[SQUARE, HOLE]], ((16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12)),
        ([[SQUARE, HOLE[::-1]]], ((16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12)),
        ([[SQUARE], [FAR]], ((16 * 2 + 4 * 11) / 20, (16 * 2 + 4 * 1) / 20)),
        ([[ring((0, 0), (4, 0), (0, 0))]], (2, 0)),
        ([[ring((3, 7), (3, 7))]], (3, 7)),
        ([[ring((3, 7))]], (3, 7)),
        ([], None),
        (None, None),
    ],
)
def test_centroid(spark, polygons, expected):
    df = spark.createDataFrame([(polygons,)], f"shape {POLYGONS}")
    point = df.selectExpr(f"{centroid('shape')} as p").selectExpr("p.x", "p.y").first()
    if expected is None:
        assert tuple(point) == (None, None)
    else:
        assert tuple(point) == pytest.approx(expected)


def test_centroid_far_from_the_origin_keeps_its_digits(spark):
    shifted = [{"x": p["x"] * 1e-3 + 4e6, "y": p["y"] * 1e-3 + 6e6} for p in SQUARE]
    df = spark.createDataFrame([([[shifted]],)], f"shape {POLYGONS}")
    point = df.selectExpr(f"{centroid('shape')} as p").selectExpr("p.x", "p.y").first()
    assert tuple(point) == pytest.approx((4e6 + 0.002, 6e6 + 0.002), abs=1e-8)


def test_with_centroid_takes_polygons_and_multipolygons(spark):
    one = spark.createDataFrame([(1, [SQUARE]), (2, None)], "k int, geometry array<array<struct<x:double,y:double>>>")
    many = spark.createDataFrame([(1, [[SQUARE], [SQUARE]])], f"k int, geometry {POLYGONS}")
    assert [tuple(r) for r in with_centroid(one).orderBy("k").collect()] == [(1, 2.0, 2.0), (2, None, None)]
    assert tuple(with_centroid(many).first()) == (1, 2.0, 2.0)


def test_projection_matches_a_published_example(spark):
    """Worked example of the two-parallel conic in the public EPSG guidance (US survey feet)."""
    degrees = lambda d, m: d + m / 60
    conic = LambertConic(
        south=degrees(28, 23),
        north=degrees(30, 17),
        origin_lat=degrees(27, 50),
        origin_lon=-99.0,
        false_easting=2000000.0,
        semi_major=20925832.16,
        inverse_flattening=294.97870,
    )
    df = spark.createDataFrame([(-96.0, 28.5)], "lon double, lat double")
    point = df.selectExpr(f"{conic.forward('lon', 'lat')} as p").first().p
    assert (point.x, point.y) == pytest.approx((2963503.91, 254759.80), abs=0.02)


def test_state_plane_origin_and_rings(spark):
    df = spark.createDataFrame(
        [([ring((-77, EPSG_2804.origin_lat), (-76.5, 39.3))],)], "rings array<array<struct<x:double,y:double>>>"
    )
    first, second = df.selectExpr(f"{EPSG_2804.forward_rings('rings')} as r").first().r[0]
    assert (first.x, first.y) == pytest.approx((400000, 0), abs=1e-6)
    assert 400000 < second.x < 500000 and 150000 < second.y < 200000
    assert not math.isnan(second.x)
