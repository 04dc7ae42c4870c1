"""Well-known binary: both byte orders, z and m, holes, and everything that can be broken."""

from __future__ import annotations

import struct

import pytest

from liengrid.functions.geometry import centroid
from liengrid.sources import wkb

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


def polygon(rings, order="<", code=3, more=(), srid=None):
    data = struct.pack(f"{order}BI", order == "<", code) + (struct.pack(f"{order}I", srid) if srid else b"")
    data += struct.pack(f"{order}I", len(rings))
    for ring in rings:
        numbers = [v for p in ring for v in (*p, *more)]
        data += struct.pack(f"{order}I{len(numbers)}d", len(ring), *numbers)
    return data


def multi(parts, order="<"):
    return struct.pack(f"{order}BII", order == "<", 6, len(parts)) + b"".join(parts)


GOOD = {
    "little": polygon([SQUARE, HOLE]),
    "big": polygon([SQUARE, HOLE], ">"),
    "z": polygon([SQUARE, HOLE], code=1003, more=(9.0,)),
    "zm": polygon([SQUARE, HOLE], ">", 3003, (9.0, 8.0)),
    "flagged": polygon([SQUARE, HOLE], code=3 | 0x80000000 | 0x20000000, more=(7.0,), srid=2804),
    "multi": multi([polygon([SQUARE, HOLE], ">")]),
}
OPEN = [*SQUARE[:-1], (9.0, 9.0)]
BROKEN = {
    "empty": b"",
    "order": b"\x07" + GOOD["little"][1:],
    "cut": GOOD["little"][:-1],
    "more": GOOD["little"] + b"\0",
    "line": polygon([SQUARE], code=2),
    "open": polygon([SQUARE, OPEN]),
    "short": polygon([SQUARE[:2] + SQUARE[:1]]),
    "nan": polygon([[(float("nan"), 0.0)] + SQUARE[1:]]),
    "huge": struct.pack("<BIII", 1, 3, 1, 2**31),
    "nested": multi([multi([polygon([SQUARE])])]),
    "one bad part": multi([polygon([SQUARE]), polygon([OPEN])]),
}


@pytest.mark.parametrize("name", GOOD)
def test_polygons(name):
    (rings,) = wkb.decode(GOOD[name])
    assert [[tuple(p) for p in r] for r in rings] == [SQUARE, HOLE]


@pytest.mark.parametrize("name", BROKEN)
def test_broken_bytes_are_null(name):
    assert wkb.decode(BROKEN[name]) is None


def test_columns_status_and_centroids(spark):
    shapes = {**GOOD, **BROKEN, "null": None, "two": multi([polygon([SQUARE]), polygon([[(x + 10, y) for x, y in SQUARE]])]), "none": multi([])}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in shapes.items()], "k string, geometry binary")
    made = wkb.with_decoded_shapes(rows.repartition(3))
    assert made.columns == ["k", "geometry", "geometry_status"]
    found = {r.k: r for r in made.selectExpr("*", f"{centroid('geometry')} as c").collect()}
    assert {k for k, r in found.items() if r.geometry_status == "broken"} == set(BROKEN)
    assert found["null"].geometry_status == "missing" and found["none"].geometry == []
    rings = "array(array(array({})))".format(",".join(f"named_struct('x',{x}D,'y',{y}D)" for x, y in SQUARE))
    holed = rings[:-1] + ")"
    assert spark.range(1).selectExpr(f"{centroid(holed)} as c").first().c.x == 2.0
    for name in GOOD:
        assert found[name].c == found["little"].c and found[name].c.x > 2.0
    assert (found["two"].c.x, found["two"].c.y) == (7.0, 2.0)
    assert made.where("false").count() == 0
