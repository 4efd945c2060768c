"""Web Mercator and the tile grid as Column builders; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
MAX_LAT = 85.05112877980659
HALF = math.pi * RADIUS
EDGE = 2 * HALF
#: Units of a tile's local grid.
EXTENT = 8192


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def mercator_y(lat: Column) -> Column:
    clamped = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * RADIUS


def lon_of(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / RADIUS)))


def axis_tiles(z: Column) -> Column:
    """Tiles along an axis at zoom z (BIGINT)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), z.cast("int"))


def tile_edge(z: Column) -> Column:
    return F.lit(EDGE) / axis_tiles(z)


def fractional_x(x: Column, z: Column) -> Column:
    return (x + HALF) / EDGE * axis_tiles(z)


def fractional_y(y: Column, z: Column) -> Column:
    return (F.lit(HALF) - y) / EDGE * axis_tiles(z)


def clamp_tile(f: Column, z: Column) -> Column:
    return F.least(F.greatest(F.floor(f), F.lit(0)), axis_tiles(z) - 1).cast("int")


def tile_x(x: Column, z: Column) -> Column:
    return clamp_tile(fractional_x(x, z), z)


def tile_y(y: Column, z: Column) -> Column:
    return clamp_tile(fractional_y(y, z), z)


def tile_bounds(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Mercator bounds of a tile; (min_x, max_y) is its north-west corner."""
    edge = tile_edge(z)
    return {"min_x": x * edge - HALF, "max_x": (x + 1) * edge - HALF, "min_y": F.lit(HALF) - (y + 1) * edge, "max_y": F.lit(HALF) - y * edge}


def parent(v: Column) -> Column:
    return F.shiftright(v, 1)


def children(x: Column, y: Column) -> Column:
    """The four tiles below, row by row: array of (x, y)."""
    return F.array(*(F.struct((2 * x + dx).alias("x"), (2 * y + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)))


def quantize(local: Column, extent: int = EXTENT) -> Column:
    """Tile-local units: rounded half away from zero, held in 0 ... extent."""
    return F.least(F.greatest(F.round(local).cast("int"), F.lit(0)), F.lit(extent))


def pack_e7(degrees: Column) -> Column:
    return F.round(degrees * 1e7).cast("int")


def unpack_e7(packed: Column) -> Column:
    return packed / 1e7


def nanodegrees(coord: Column, granularity: int, offset: int) -> Column:
    return (coord.cast("decimal(38,0)") * granularity + offset).cast("double") * 1e-9


def simplify_tolerance(px: float, extent: int, render_px: int) -> float:
    """Tile units: so many rendered pixels, one unit at least."""
    return max(px * extent / render_px, 1.0)


def effective_zoom(zoom: Column, tile_px: int = 512, base_px: int = 256) -> Column:
    return zoom + math.log2(tile_px / base_px)


def visible_range(x: Column, y: Column, zoom: Column, bearing: Column, width: Column, height: Column, level: Column, *, margin: int = 0, tile_px: int = 512) -> dict[str, Column]:
    """Tile rectangle at `level` that a viewport of width by height px around (x, y) sees, turned by bearing degrees."""
    metres = F.lit(EDGE) / (F.pow(F.lit(2.0), zoom) * tile_px)
    cos, sin = F.abs(F.cos(F.radians(bearing))), F.abs(F.sin(F.radians(bearing)))
    half_x = (width * cos + height * sin) / 2 * metres
    half_y = (width * sin + height * cos) / 2 * metres
    n = axis_tiles(level)
    hold = lambda v: F.least(F.greatest(v, F.lit(0)), n - 1).cast("int")
    return {
        "min_tx": hold(F.floor(fractional_x(x - half_x, level)) - margin),
        "max_tx": hold(F.floor(fractional_x(x + half_x, level)) + margin),
        "min_ty": hold(F.floor(fractional_y(y + half_y, level)) - margin),
        "max_ty": hold(F.floor(fractional_y(y - half_y, level)) + margin),
    }
