"""Geometry as column maths: polygon centroids and a conic projection.

A polygon is an array of closed rings, outline first and holes after it; a ring is an
array of points with fields x and y. A multipolygon is an array of polygons.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


# Sums over the sides of a ring, with coordinates seen from the first point of the shape:
# area is twice the signed area, the other sums are moments of area and of length.
_ZERO = """named_struct('area', 0D, 'area_x', 0D, 'area_y', 0D, 'length', 0D, 'length_x', 0D, 'length_y', 0D)"""
_RING = """
    aggregate(
        zip_with(slice(ring, 1, greatest(size(ring) - 1, 0)), slice(ring, 2, greatest(size(ring) - 1, 0)),
            (a, b) -> named_struct(
                'ax', a.x - {origin}.x, 'ay', a.y - {origin}.y, 'bx', b.x - {origin}.x, 'by', b.y - {origin}.y)),
        {zero},
        (sums, side) -> named_struct(
            'area', sums.area + side.ax * side.by - side.bx * side.ay,
            'area_x', sums.area_x + (side.ax + side.bx) * (side.ax * side.by - side.bx * side.ay),
            'area_y', sums.area_y + (side.ay + side.by) * (side.ax * side.by - side.bx * side.ay),
            'length', sums.length + hypot(side.bx - side.ax, side.by - side.ay),
            'length_x', sums.length_x + (side.ax + side.bx) * hypot(side.bx - side.ax, side.by - side.ay),
            'length_y', sums.length_y + (side.ay + side.by) * hypot(side.bx - side.ax, side.by - side.ay)),
        sums -> named_struct(
            'sign', if(i = 0, signum(sums.area), -signum(sums.area)), 'sums', sums))"""
_SHAPE = """
    aggregate(
        flatten(transform({polygons}, polygon -> transform(polygon, (ring, i) -> {ring}))),
        {zero},
        (total, part) -> named_struct(
            'area', total.area + part.sign * part.sums.area,
            'area_x', total.area_x + part.sign * part.sums.area_x,
            'area_y', total.area_y + part.sign * part.sums.area_y,
            'length', total.length + part.sums.length,
            'length_x', total.length_x + part.sums.length_x,
            'length_y', total.length_y + part.sums.length_y),
        total -> named_struct(
            'x', {origin}.x + case when total.area > 0 then total.area_x / (3 * total.area)
                when total.length > 0 then total.length_x / (2 * total.length) else 0 end,
            'y', {origin}.y + case when total.area > 0 then total.area_y / (3 * total.area)
                when total.length > 0 then total.length_y / (2 * total.length) else 0 end))"""


def centroid(polygons: str) -> str:
    """G1: area centroid of a multipolygon column as struct(x, y); null without geometry.

    The first ring of a polygon adds area and the others take it away, whichever way
    they run. A shape without area falls back to its outline, and one without length
    to its first point.
    """
    origin = f"get(get(get({polygons}, 0), 0), 0)"
    ring = _RING.format(origin=origin, zero=_ZERO)
    return _SHAPE.format(polygons=polygons, ring=ring, zero=_ZERO, origin=origin)


@dataclass(frozen=True)
class LambertConic:
    """Lambert conformal conic projection with two standard parallels (degrees, metres)."""

    south: float
    north: float
    origin_lat: float
    origin_lon: float
    false_easting: float = 0.0
    false_northing: float = 0.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101

    @property
    def eccentricity(self) -> float:
        flattening = 1 / self.inverse_flattening
        return math.sqrt(2 * flattening - flattening**2)

    def _scale(self, lat: float) -> float:
        sine = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - (self.eccentricity * sine) ** 2)

    def _conformal(self, lat: float) -> float:
        es = self.eccentricity * math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - es) / (1 + es)) ** (self.eccentricity / 2)

    @property
    def cone(self) -> float:
        ratio = math.log(self._scale(self.south) / self._scale(self.north))
        return ratio / math.log(self._conformal(self.south) / self._conformal(self.north))

    @property
    def radius_factor(self) -> float:
        return self.semi_major * self._scale(self.south) / (self.cone * self._conformal(self.south) ** self.cone)

    @property
    def origin_radius(self) -> float:
        return self.radius_factor * self._conformal(self.origin_lat) ** self.cone

    def forward(self, lon: str, lat: str) -> str:
        """Longitude and latitude in degrees to struct(x, y) in metres."""
        es = f"{self.eccentricity!r}D * sin(radians({lat}))"
        conformal = f"tan(pi() / 4 - radians({lat}) / 2) / power((1 - {es}) / (1 + {es}), {self.eccentricity / 2!r}D)"
        radius = f"({self.radius_factor!r}D * power({conformal}, {self.cone!r}D))"
        angle = f"({self.cone!r}D * radians({lon} - ({self.origin_lon!r}D)))"
        return f"""named_struct(
            'x', {self.false_easting!r}D + {radius} * sin({angle}),
            'y', {self.origin_radius + self.false_northing!r}D - {radius} * cos({angle}))"""

    def inverse(self, x: str, y: str) -> str:
        """G2 back: metres to struct(x, y) of longitude and latitude in degrees; the latitude by fixed-point steps."""
        east, north = f"({x} - {self.false_easting!r}D)", f"({self.origin_radius + self.false_northing!r}D - {y})"
        radius = f"sqrt({east} * {east} + {north} * {north})"
        conformal = f"power({radius} / {self.radius_factor!r}D, {1 / self.cone!r}D)"
        es = f"({self.eccentricity!r}D * sin(phi))"
        step = f"pi() / 2 - 2 * atan({conformal} * power((1 - {es}) / (1 + {es}), {self.eccentricity / 2!r}D))"
        lat = f"aggregate(sequence(1, {LATITUDE_STEPS}), pi() / 2 - 2 * atan({conformal}), (phi, i) -> {step})"
        return f"""named_struct(
            'x', {self.origin_lon!r}D + degrees(atan2({east}, {north}) / {self.cone!r}D),
            'y', degrees({lat}))"""

    def forward_rings(self, rings: str) -> str:
        """G2 over every point of a polygon."""
        return over_points(rings, 2, self.forward)

    def forward_all(self, geometry: str, kind: str) -> str:
        """G2 over a point, line, polygon or multipolygon column; kind is its type, which says how deep it is."""
        return over_points(geometry, nesting(kind), self.forward)


# Each step brings the latitude nearer by the square of the eccentricity, about 150 times.
LATITUDE_STEPS = 7


def nesting(kind: str) -> int:
    """How many arrays a type such as array<array<struct<x:double,y:double>>> has around its points."""
    depth = 0
    while kind.startswith("array<"):
        kind, depth = kind[len("array<") : -1], depth + 1
    if not kind.startswith("struct<"):
        raise ValueError(f"points must be structs of x and y, not {kind}")
    return depth


def over_points(geometry: str, depth: int, change) -> str:
    """change(x, y) for every point below `depth` arrays; what is null stays null."""
    if depth == 0:
        return f"if({geometry} is null, null, {change(f'{geometry}.x', f'{geometry}.y')})"
    part = f"part{depth}"
    return f"transform({geometry}, {part} -> {over_points(part, depth - 1, change)})"


# Parameters of EPSG:2804 (Maryland state plane, metres, GRS 80).
EPSG_2804 = LambertConic(
    south=38.3,
    north=39.45,
    origin_lat=37.666666666666664,
    origin_lon=-77.0,
    false_easting=400000.0,
    false_northing=0.0,
    semi_major=6378137.0,
    inverse_flattening=298.257222101,
)
