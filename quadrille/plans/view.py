"""What a camera sees of an archive: visible tiles, decoded, lifted to one frame, welded, blended and in drawing order."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..functions.kinds import kind_dimension, road_width
from ..operators import network as N
from ..operators import shapes as S
from ..sources import pmtiles as P

TILE_PX = 512


@dataclass(frozen=True)
class Camera:
    lon: float
    lat: float
    zoom: float
    bearing: float
    viewport: tuple[int, int]


def metres(c: Camera) -> tuple[float, float]:
    lat = max(-M.MAX_LAT, min(M.MAX_LAT, c.lat))
    return math.radians(c.lon) * M.RADIUS, M.RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def to_screen(c: Camera, x: float, y: float) -> tuple[float, float]:
    """Pixels of a Mercator point: centred, turned by the bearing, scaled, y down."""
    cx, cy = metres(c)
    scale, b = TILE_PX * 2**c.zoom / M.EDGE, math.radians(c.bearing)
    dx, dy = (x - cx) * scale, (cy - y) * scale
    return dx * math.cos(b) + dy * math.sin(b) + c.viewport[0] / 2, dy * math.cos(b) - dx * math.sin(b) + c.viewport[1] / 2


def panned(c: Camera, dx: float, dy: float) -> Camera:
    """The camera after the map was dragged by so many pixels."""
    x, y = metres(c)
    scale, b = M.EDGE / (TILE_PX * 2**c.zoom), math.radians(c.bearing)
    mx, my = dx * math.cos(b) - dy * math.sin(b), dy * math.cos(b) + dx * math.sin(b)
    x, y = x - mx * scale, y + my * scale
    return replace(c, lon=math.degrees(x / M.RADIUS), lat=math.degrees(math.atan(math.sinh(y / M.RADIUS))))


def zoomed(c: Camera, by: float) -> Camera:
    return replace(c, zoom=min(20.0, max(3.0, c.zoom + by)))


def level_of(c: Camera, zooms: list[int]) -> int:
    """The archive's level nearest to the zoom for tiles of 256 px, of two the coarser."""
    return min(zooms, key=lambda z: (abs(z - (c.zoom + math.log2(TILE_PX / 256))), z))


def visible(c: Camera, level: int, margin: int = 0) -> list[tuple[int, int, int]]:
    """Tiles of a level that the turned viewport's box meets, row by row."""
    x, y = metres(c)
    m, b, (w, h) = M.EDGE / (TILE_PX * 2**c.zoom), math.radians(c.bearing), c.viewport
    hx, hy = (w * abs(math.cos(b)) + h * abs(math.sin(b))) / 2 * m, (w * abs(math.sin(b)) + h * abs(math.cos(b))) / 2 * m
    n = 1 << level
    span = lambda lo, hi: range(min(max(math.floor(lo / M.EDGE * n) - margin, 0), n - 1), min(max(math.floor(hi / M.EDGE * n) + margin, 0), n - 1) + 1)
    return [(level, tx, ty) for ty in span(M.HALF - y - hy, M.HALF - y + hy) for tx in span(x - hx + M.HALF, x + hx + M.HALF)]


def tiles_or_ancestors(archive: P.Archive, wanted: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], bytes]:
    """The tiles that the archive has. Only beyond its last level the nearest ancestor, once, stands for a tile; an absent tile of a level that the archive holds has nothing to show."""
    out: dict[tuple[int, int, int], bytes] = {}
    while wanted:
        found = zip(wanted, archive.tiles(wanted), strict=True)
        absent = []
        for t, d in found:
            if d is not None:
                out[t] = d
            elif t[0] > max(archive.zooms):
                absent.append((t[0] - 1, t[1] >> 1, t[2] >> 1))
        wanted = sorted(set(absent) - set(out))
    return out


def scene(spark: SparkSession, path: str, camera: Camera, extent: int = M.EXTENT, level: int | None = None) -> dict[str, DataFrame]:
    """roads, areas, labels, pois of what the camera sees, in units of the level's frame. The driver reads a viewport's tiles only; shapes are decoded and joined by Spark."""
    archive = P.Archive(path)
    level = level_of(camera, archive.zooms) if level is None else level
    data = [(*t, d) for t, d in tiles_or_ancestors(archive, visible(camera, level)).items()]
    level = max([t[0] for t in data], default=level)
    found = S.decoded(spark.createDataFrame(data, "z INT, tx INT, ty INT, data BINARY"))
    dim = kind_dimension(spark).select("shape", F.col("ordinal").alias("kind"), "display_min_zoom", F.col("rank").alias("draw"), "default_lanes")
    shown = found.join(F.broadcast(dim), ["shape", "kind"]).where(F.col("display_min_zoom") <= math.floor(camera.zoom))
    lift = lambda p: F.struct((F.col("tx").cast("double") * extent + p["x"]).alias("x"), (F.col("ty").cast("double") * extent + p["y"]).alias("y"))
    shown = shown.withColumn("rings", F.transform("coords", lambda ring: F.transform(ring, lift))).withColumn("scene", F.lit(0).cast("bigint"))
    pieces = shown.where("shape = 'road'").withColumn("coords", F.get("rings", F.lit(0))).withColumn("id", F.col("tile_id") * 65536 + F.col("id"))
    roads = S.welded(pieces, "scene", max(extent / 1024, 1.0)).withColumn("road", F.col("id"))
    total = lambda v: v["fwd"] + v["bwd"]
    end = lambda side, p: F.struct(F.lit(side).alias("side"), p["x"].alias("x"), p["y"].alias("y"))
    ends = roads.withColumn("e", F.explode(F.array(end(0, F.get("coords", F.lit(0))), end(1, F.element_at("coords", -1))))).select("kind", "road", F.col("e.side").alias("side"), F.col("e.x").alias("x"), F.col("e.y").alias("y"), total(F.when(F.col("e.side") == 0, F.get("lanes", F.lit(0))).otherwise(F.element_at("lanes", -1))).alias("lanes"))
    blended = N.blend_widths(ends, max(extent // 1024, 1)).groupBy("road").pivot("side", [0, 1]).agg(F.first("blended"))
    roads = roads.join(blended.select("road", F.col("0").alias("lanes_start"), F.col("1").alias("lanes_end")), "road", "left").join(F.broadcast(dim.where("shape = 'road'").select("kind", "draw", "default_lanes")), "kind")
    roads = N.painter_order(roads, ["scene"], ["layer", "draw", "kind", "road"])
    areas = N.painter_order(shown.where("shape = 'area'").withColumn("rings", F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))), ["scene"], ["layer", "kind", "floors", "tile_id", "id"])
    points = shown.withColumn("at", F.get(F.get("rings", F.lit(0)), F.lit(0)))
    return {
        "roads": roads.select("kind", "road", "coords", "layer", "name", "structure", "start", "end", "lanes", "lanes_start", "lanes_end", *(road_width(F.col(k), F.col("default_lanes")).alias(k.replace("lanes", "width")) for k in ("lanes_start", "lanes_end")), "rank"),
        "areas": areas.select("kind", "layer", "floors", "rings", "rank"),
        "labels": points.where("shape = 'label'").select("kind", "name", "at.x", "at.y", "draw"),
        "pois": points.where("shape = 'poi'").select("kind", "at.x", "at.y"),
    }
