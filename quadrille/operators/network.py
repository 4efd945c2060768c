"""Ways, nodes and relations: resolving coordinates, junctions, members, tile cover, clipping and blending, by joins and windows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import mercator as M


def refs_of(ways: DataFrame) -> DataFrame:
    """way_id, pos, node_id: a row for each reference."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with lon, lat; references to absent nodes are skipped."""
    return refs.join(nodes.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id").select("way_id", "pos", "node_id", "lon", "lat")


def projected(nodes: DataFrame) -> DataFrame:
    """id, x, y: nodes in Mercator metres, the same to the last bit as by SQL's tan and ln, which are the C library's; the JVM's y differs in the last place at one of 15 latitudes from 35 to 85 degrees, which rounds some areas otherwise."""

    def northing(lat: float | None) -> float | None:
        return None if lat is None else math.log(math.tan(math.pi / 4 + math.radians(min(max(lat, -M.MAX_LAT), M.MAX_LAT)) / 2)) * M.RADIUS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lats = batch.column("lat").to_pylist()
            known = {v: northing(v) for v in set(lats)}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array([known[v] for v in lats], pa.float64())], ["id", "x", "y"])

    return nodes.select("id", M.mercator_x(F.col("lon")).alias("x"), "lat").mapInArrow(run, "id BIGINT, x DOUBLE, y DOUBLE")


def placed(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with x, y; each node is projected once, and references to absent nodes are skipped."""
    return refs.join(projected(nodes).withColumnRenamed("id", "node_id"), "node_id").select("way_id", "pos", "node_id", "x", "y")


def lines(placed: DataFrame) -> DataFrame:
    """way_id, coords: each way's Mercator vertices in order; ways with fewer than two are no lines."""
    point = F.struct("pos", "x", "y")
    coords = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return placed.groupBy("way_id").agg(coords.alias("coords")).where(F.size("coords") >= 2)


def junctions(refs: DataFrame) -> DataFrame:
    """node_id, refs: nodes with two references or more; a way that comes back counts again."""
    return refs.groupBy("node_id").agg(F.count("*").alias("refs")).where("refs >= 2")


def members_of(relations: DataFrame) -> DataFrame:
    """rel_id, pos, way_id, is_hole: way members; the role `inner` is a hole, any other an outer."""
    m = relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m"))
    return m.where("m.type = 'way'").select("rel_id", "pos", F.col("m.id").alias("way_id"), (F.col("m.role") == "inner").alias("is_hole"))


def super_relation_ways(relations: DataFrame, matched: DataFrame) -> DataFrame:
    """way_id: way members of the matched relations and of the relations that they have as members, one level down."""
    m = relations.select(F.col("id").alias("rel_id"), F.explode("members").alias("m")).select("rel_id", F.col("m.id").alias("id"), F.col("m.type").alias("type"))
    below = m.where("type = 'relation'").join(matched.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select(F.col("id").alias("rel_id"))
    wanted = matched.select(F.col("id").alias("rel_id")).union(below).distinct()
    return m.where("type = 'way'").join(wanted, "rel_id", "left_semi").select(F.col("id").alias("way_id")).distinct()


def with_any(df: DataFrame, group: str, test: Column) -> DataFrame:
    """Rows of groups in which any row passes the test: a semi-join, so that no group meets in one task."""
    return df.join(df.where(test).select(group).distinct(), group, "left_semi")


def across_zooms(df: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    return df.withColumn("z", F.explode(F.array(*map(F.lit, sorted(zooms)))))


def cover(df: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str) -> DataFrame:
    """df (with z) with tx, ty: each tile that a Mercator box meets."""
    z = F.col("z")
    xs = F.sequence(M.tile_x(F.col(min_x), z), M.tile_x(F.col(max_x), z))
    ys = F.sequence(M.tile_y(F.col(max_y), z), M.tile_y(F.col(min_y), z))
    return df.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))


def segments(lines_: DataFrame) -> DataFrame:
    """way_id, seg, ax, ay, bx, by: neighbouring vertices."""
    n = F.size("coords")
    pair = F.zip_with(F.slice("coords", F.lit(1), n - 1), F.slice("coords", F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return lines_.select("way_id", F.posexplode(pair).alias("seg", "s")).select("way_id", "seg", "s.*")


def once(df: DataFrame, kept: list[str], values: dict[str, Column]) -> DataFrame:
    """The kept columns and values, each value worked out once a row, however often later columns name it."""
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def clip_to_tiles(segs: DataFrame, z: int, extent: int = M.EXTENT) -> DataFrame:
    """Pieces of segments in the tiles of zoom z: way_id, seg, tx, ty, local ends x0, y0, x1, y1, cut_start, cut_end.

    A segment that only touches a tile gives a piece of no length there. Each step's values are generated as one row, since
    Spark else writes each in full wherever the next step names it, into methods too long to be compiled."""
    zc = F.lit(z)
    place = {"fax": M.fractional_x(F.col("ax"), zc), "fay": M.fractional_y(F.col("ay"), zc), "fbx": M.fractional_x(F.col("bx"), zc), "fby": M.fractional_y(F.col("by"), zc)}
    span = lambda a, b: F.explode(F.sequence(M.clamp_tile(F.least(a, b), zc), M.clamp_tile(F.greatest(a, b), zc)))
    s = once(segs, ["way_id", "seg"], place).withColumn("tx", span("fax", "fbx")).withColumn("ty", span("fay", "fby"))
    kept = ["way_id", "seg", "tx", "ty"]
    s = once(s, kept, {"fax": F.col("fax") - F.col("tx"), "fay": F.col("fay") - F.col("ty"), "fbx": F.col("fbx") - F.col("tx"), "fby": F.col("fby") - F.col("ty")})
    t0, t1, meets = G.clip_segment(F.col("fax"), F.col("fay"), F.col("fbx"), F.col("fby"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    s = once(s, [*kept, "fax", "fay", "fbx", "fby"], {"t0": t0, "t1": t1, "meets": meets}).where("meets")
    at = lambda a, b, t: M.quantize((F.col(a) + (F.col(b) - F.col(a)) * F.col(t)) * extent, extent)
    return s.select("way_id", "seg", "tx", "ty", at("fax", "fbx", "t0").alias("x0"), at("fay", "fby", "t0").alias("y0"), at("fax", "fbx", "t1").alias("x1"), at("fay", "fby", "t1").alias("y1"), (F.col("t0") > 0).alias("cut_start"), (F.col("t1") < 1).alias("cut_end"))


def blend_widths(ends: DataFrame, tolerance: int) -> DataFrame:
    """ends (kind, road, side, x, y, lanes) with blended: the most lanes of any end of another road of the kind within the tolerance, if more than its own.

    Ends are listed in the nine cells around theirs, so that the tolerance join is one on equal cells."""
    cell = ends.withColumns({"cx": F.floor(F.col("x") / tolerance), "cy": F.floor(F.col("y") / tolerance)})
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    near = cell.withColumn("d", F.explode(around)).select("kind", F.col("road").alias("o_road"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("lanes").alias("o_lanes"), (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    close = (F.col("road") != F.col("o_road")) & (F.abs(F.col("x") - F.col("ox")) <= tolerance) & (F.abs(F.col("y") - F.col("oy")) <= tolerance)
    most = cell.join(near, ["kind", "cx", "cy"]).where(close).groupBy("road", "side").agg(F.max("o_lanes").alias("most"))
    return ends.join(most, ["road", "side"], "left").withColumn("blended", F.greatest("lanes", F.coalesce("most", "lanes"))).drop("most")


def near_boxes(boxes: DataFrame, margin: float, cell: float) -> DataFrame:
    """a, b (a < b): boxes (id, min_x, min_y, max_x, max_y) within the margin, by a join on grid cells that boxes, widened by half the margin, meet; each pair in the first cell that both meet."""
    half = margin / 2
    lo = lambda c: F.floor((F.col(c) - half) / cell)
    hi = lambda c: F.floor((F.col(c) + half) / cell)
    b = boxes.withColumns({"gx0": lo("min_x"), "gy0": lo("min_y"), "gx": F.explode(F.sequence(lo("min_x"), hi("max_x")))}).withColumn("gy", F.explode(F.sequence(lo("min_y"), hi("max_y"))))
    left, right = b.alias("l"), b.alias("r")
    first = (F.col("l.gx") == F.greatest("l.gx0", "r.gx0")) & (F.col("l.gy") == F.greatest("l.gy0", "r.gy0"))
    meet = (F.col("l.min_x") <= F.col("r.max_x") + margin) & (F.col("r.min_x") <= F.col("l.max_x") + margin) & (F.col("l.min_y") <= F.col("r.max_y") + margin) & (F.col("r.min_y") <= F.col("l.max_y") + margin)
    return left.join(right, (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")) & (F.col("l.id") < F.col("r.id")) & meet & first).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def layer_by_weight(df: DataFrame, group: str, layer: str, weight: str) -> DataFrame:
    """group, layer: the layer with the most weight, of equal ones the higher."""
    sums = df.groupBy(group, layer).agg(F.sum(weight).alias("w"))
    return sums.groupBy(group).agg(F.max_by(layer, F.struct("w", layer)).alias(layer))


def painter_order(df: DataFrame, scene: list[str], order: list[str]) -> DataFrame:
    """rank of each shape within its scene, drawn first to last."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*scene).orderBy(*order)))
