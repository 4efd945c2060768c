"""Plane geometry on ARRAY<STRUCT<x, y>> and on scalar columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import RADIUS


def bbox(coords: Column) -> Column:
    """STRUCT<min_x, min_y, max_x, max_y>."""
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def ring_area(coords: Column) -> Column:
    """Area by the shoelace formula; the ring may be open or closed."""
    after = F.concat(F.slice(coords, 2, F.size(coords)), F.slice(coords, 1, 1))
    cross = F.zip_with(coords, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def ground_length(coords: Column) -> Column:
    """Metres on the ground of a Mercator line: its length over cosh of the mean latitude of its segments' starts."""
    n = F.size(coords)
    starts, ends = F.slice(coords, F.lit(1), n - 1), F.slice(coords, F.lit(2), n - 1)
    length = F.aggregate(F.zip_with(starts, ends, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))), F.lit(0.0), lambda s, v: s + v)
    mean = F.aggregate(starts, F.lit(0.0), lambda s, p: s + p["y"]) / (n - 1)
    return F.when(n < 2, F.lit(0.0)).otherwise(length / F.cosh(mean / RADIUS))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column]:
    """Where a segment enters and leaves a rectangle (0 ... 1 of its length), and whether it meets it; touching counts."""
    dx, dy = bx - ax, by - ay
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        outside = outside | ((p == 0) & (q < 0))
        low.append(F.when(p < 0, q / p).otherwise(0.0))
        high.append(F.when(p > 0, q / p).otherwise(1.0))
    t0, t1 = F.greatest(*low), F.least(*high)
    return t0, t1, ~outside & (t0 <= t1)


def bbox_overlap(a: Column, b: Column, margin: float) -> Column:
    return (a["min_x"] <= b["max_x"] + margin) & (b["min_x"] <= a["max_x"] + margin) & (a["min_y"] <= b["max_y"] + margin) & (b["min_y"] <= a["max_y"] + margin)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """By the even-odd rule."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + v) % 2 == 1


def close_ring(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def canonical_ring(ring: Column) -> Column:
    """An open ring turned so that it begins with its smallest vertex."""
    k = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, k, F.size(ring)), F.slice(ring, F.lit(1), k - 1))


def to_scene(local: Column, tile: Column, target_z: Column, source_z: Column, extent: int) -> Column:
    """Tile-local units as units of the scene's frame."""
    return F.call_function("shiftleft", (tile * extent + local).cast("bigint"), (target_z - source_z).cast("int"))
