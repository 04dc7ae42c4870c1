"""Polygons and multipolygons in well-known binary, decoded to rings batch by batch."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<array<struct<x:double,y:double>>>>"

# Geometry types, and the flags and offsets by which a type says that points have z, m or an id before them.
_POLYGON, _MULTIPOLYGON = 3, 6
_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000


class BrokenGeometry(ValueError):
    """Bytes that are no polygon or multipolygon, or have a ring that is none."""


def _ring(data: bytes, at: int, order: str, dimensions: int) -> tuple[np.ndarray, int]:
    (count,) = struct.unpack_from(f"{order}I", data, at)
    end = at + 4 + 8 * count * dimensions
    if count < 4 or end > len(data):
        raise BrokenGeometry(f"a ring of {count} points at byte {at}")
    points = np.frombuffer(data, f"{order}f8", count * dimensions, at + 4).reshape(count, dimensions)[:, :2]
    if not np.isfinite(points).all() or (points[0] != points[-1]).any():
        raise BrokenGeometry(f"a ring that is open or not finite at byte {at}")
    return points.astype(float), end


def _shape(data: bytes, at: int, is_part: bool = False) -> tuple[list[list[np.ndarray]], int]:
    """The polygons of the geometry that begins at a byte, as lists of rings, and the byte after it."""
    if data[at] > 1:
        raise BrokenGeometry("an unknown byte order")
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & _HAS_SRID else 5
    plain = code & 0x0FFFFFFF
    dimensions = 2 + bool(code & _HAS_Z) + bool(code & _HAS_M) + (0, 1, 1, 2)[min(plain // 1000, 3)]
    (count,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if plain % 1000 == _POLYGON:
        rings = []
        for _ in range(count):
            ring, at = _ring(data, at, order, dimensions)
            rings.append(ring)
        return [rings], at
    if plain % 1000 != _MULTIPOLYGON or is_part:
        raise BrokenGeometry(f"geometry type {plain}")
    polygons = []
    for _ in range(count):
        part, at = _shape(data, at, is_part=True)
        polygons += part
    return polygons, at


def decode(data: bytes | None) -> list[list[np.ndarray]] | None:
    """Polygons of rings of points, or None for bytes that are no whole geometry."""
    if data is None:
        return None
    try:
        polygons, end = _shape(data, 0)
    except (BrokenGeometry, struct.error, IndexError):
        return None
    return polygons if end == len(data) else None


def _nested(shapes: list) -> pa.Array:
    """Decoded shapes as one nested array: points lie end to end, offsets say which ring, polygon and shape they are of."""
    points: list[np.ndarray] = []
    rings, polygons, whole = [0], [0], [0]
    for shape in shapes:
        for polygon in shape or []:
            for ring in polygon:
                points.append(ring)
                rings.append(rings[-1] + len(ring))
            polygons.append(len(rings) - 1)
        whole.append(len(polygons) - 1)
    flat = np.concatenate(points) if points else np.zeros((0, 2))
    coordinates = [pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)]
    made = pa.StructArray.from_arrays(coordinates, names=["x", "y"])
    for offsets in (rings, polygons):
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)
    missing = pa.array([s is None for s in shapes], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(whole, pa.int32()), made, mask=missing)


def wkb_rings(column: str) -> Column:
    """The rings of a binary column as a multipolygon; null for null and for broken bytes.

    Every ring must be closed, finite and of four points at least, and the bytes must end with the geometry. Both byte
    orders and points with z or m (dropped) are read.
    """

    @F.arrow_udf(RINGS)
    def rings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _nested([decode(value) for value in batch.to_pylist()])

    return rings(F.col(column))


def with_decoded_shapes(df: DataFrame, column: str = "geometry", status: str = "geometry_status") -> DataFrame:
    """Replaces a binary column by its rings, and says of each row whether they are read, missing or broken."""
    named = df.withColumnRenamed(column, "_wkb").withColumn(column, wkb_rings("_wkb"))
    state = f"case when _wkb is null then 'missing' when `{column}` is null then 'broken' else 'read' end"
    return named.withColumn(status, F.expr(state)).drop("_wkb")
