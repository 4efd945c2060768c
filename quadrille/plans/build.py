"""From nodes, ways, relations and water to a tile archive: one declarative plan for each kind of shape, one shuffle by tile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..functions import tags as C
from ..functions.kinds import ZOOMS
from ..kernels.pmtiles import Header
from ..operators import network as N
from ..operators import shapes as S
from ..operators.storage import new_path, reused, staged
from ..sources import register
from ..sources.pmtiles import write_archive
from ..sources.ranges import open_ranges


@dataclass(frozen=True)
class TileBuildConfig:
    zooms: tuple[int, ...] = ZOOMS
    simplify_px: float = 4.0
    tile_render_px: int = 360
    agg_max_zoom: int = 12
    road_agg_max_zoom: int = 12
    mask_zoom: int = 14
    clip_water_to_extract_bbox: bool = False
    extent: int = M.EXTENT


def read_extract(spark: SparkSession, path: str, keep: str | None = None) -> dict[str, DataFrame]:
    """nodes, ways and relations of a PBF file, each staged as a table, so that later passes read columns. keep: a folder whose tables later builds of the same file use again."""
    register(spark)
    kinds = ("nodes", "ways", "relations")
    read = lambda kind: spark.read.format("osmpbf").option("kind", kind).load(path)
    if keep is None:
        return {kind: staged(read(kind), kind) for kind in kinds}
    key = f"{path} {open_ranges(path).size()}"
    return {kind: reused(lambda kind=kind: read(kind), spark, f"{keep}/{kind}", key) for kind in kinds}


def read_water(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("shp").load(path).select("rings")


def _shape(df: DataFrame, shape: str, **columns: Column) -> DataFrame:
    defaults = {"layer": F.lit(0), "floors": F.lit(0), "lanes_fwd": F.lit(0), "lanes_bwd": F.lit(0), "structure": F.lit(0), "start": F.lit(1), "end": F.lit(1), "name": F.lit(None).cast("string"), "junctions": F.array().cast("array<boolean>"), "aggregated": F.lit(False)}
    kinds = {"id": "bigint", "name": "string", "junctions": "array<boolean>", "aggregated": "boolean", "rings": "array<array<struct<x:double,y:double>>>"}
    every = {**defaults, **columns}
    return df.select(F.lit(shape).alias("shape"), *(every[k].cast(kinds.get(k, "int")).alias(k) for k in ("id", "kind", "layer", "floors", "lanes_fwd", "lanes_bwd", "structure", "start", "end", "name", "rings", "junctions", "aggregated")))


def vertices(refs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, points, node_ids: references (key, pos, node_id) to nodes that exist, resolved and in order."""
    at = refs.join(nodes.select(F.col("id").alias("node_id"), M.mercator_x(F.col("lon")).alias("x"), M.mercator_y(F.col("lat")).alias("y")), "node_id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "x", "y", "node_id")))
    return at.groupBy(key).agg(rows.alias("v")).select(key, F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), F.transform("v", lambda p: p["node_id"]).alias("node_ids"))


def opened(ring: Column) -> Column:
    return F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def way_shapes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Roads and closed areas, and labels of named areas."""
    kept = ways.where(C.matches(F.col("tags"), C.WAY_FILTER)).withColumn("c", C.classify_way(F.col("tags"))).where("c IS NOT NULL AND size(refs) >= 2")
    kept = staged(kept.select("id", "refs", "tags", F.col("c.shape").alias("shape"), F.col("c.kind").alias("kind")), "ways")
    refs = N.refs_of(kept)
    road_refs = refs.join(kept.where("shape = 'road'").select(F.col("id").alias("way_id")), "way_id", "left_semi")
    junction = N.junctions(road_refs).select("node_id", F.lit(True).alias("j"))
    at = refs.join(junction, "node_id", "left").join(nodes.select(F.col("id").alias("node_id"), M.mercator_x(F.col("lon")).alias("x"), M.mercator_y(F.col("lat")).alias("y")), "node_id")
    v = at.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", F.coalesce("j", F.lit(False)).alias("j")))).alias("v"))
    resolved = staged(kept.join(v, F.col("id") == F.col("way_id")).select("id", "refs", "tags", "shape", "kind", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), F.transform("v", lambda p: p["j"]).alias("flags")), "lines")
    lanes, t = C.lanes_of(F.col("tags")), F.col("tags")
    roads = resolved.where("shape = 'road' AND size(points) >= 2")
    state = lambda f: C.edge_state(f, F.lit(False))
    roads = _shape(roads, "road", id=F.col("id"), kind=F.col("kind"), layer=C.way_layer(t), lanes_fwd=lanes["forward"], lanes_bwd=lanes["backward"], structure=C.structure_of(t), start=state(F.get("flags", F.lit(0))), end=state(F.element_at("flags", -1)), name=C.name_of(t), rings=F.array("points"), junctions=F.col("flags"))
    closed = resolved.where((F.col("shape") == "area") & C.is_ring(F.col("refs"))).withColumn("ring", opened(F.col("points"))).where("size(ring) >= 3")
    areas = _shape(closed, "area", id=F.col("id"), kind=F.col("kind"), layer=C.way_layer(t), floors=C.floors_of(t), rings=F.array("ring"), name=C.name_of(t))
    return roads.unionByName(areas)


def relation_shapes(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Areas of multipolygon relations."""
    kept = relations.where(C.matches(F.col("tags"), C.RELATION_FILTER)).withColumn("kind", C.classify_relation(F.col("tags"))).where("kind IS NOT NULL")
    kept = staged(kept.select("id", "tags", "members", "kind"), "relations")
    members = N.members_of(kept).join(ways.select(F.col("id").alias("way_id"), "refs"), "way_id")
    rings = staged(S.rings_of(members.select("rel_id", "is_hole", "pos", "refs")).withColumn("key", F.struct("rel_id", "is_hole", "ring")), "rings")
    points = vertices(rings.select("key", F.posexplode("refs").alias("pos", "node_id")), nodes, "key").select("key.*", "points")
    polygons = S.multipolygons(points).join(kept.select(F.col("id").alias("rel_id"), "tags", "kind"), "rel_id")
    t = F.col("tags")
    return _shape(polygons, "area", id=F.col("rel_id"), kind=F.col("kind"), layer=C.layer_of(t), floors=C.floors_of(t), rings=F.col("rings"), name=C.name_of(t))


def area_labels(areas: DataFrame) -> DataFrame:
    """A label inside the largest polygon of each named water, forest or grass."""
    from ..kernels.areas import interior_point

    named = areas.withColumn("class", C.area_label(F.col("kind"))).where("class IS NOT NULL AND name IS NOT NULL AND NOT aggregated")
    xs, ys = F.transform(F.get("rings", F.lit(0)), lambda p: p["x"]), F.transform(F.get("rings", F.lit(0)), lambda p: p["y"])
    box = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    largest = named.withColumn("box", box).groupBy("id", "class", "name").agg(F.max_by("rings", "box").alias("rings"))

    def run(r: dict) -> list[dict]:
        x, y = interior_point([[(p["x"], p["y"]) for p in ring] for ring in r["rings"]])
        return [{"id": r["id"], "class": r["class"], "name": r["name"], "rings": [[{"x": x, "y": y}]]}]

    at = S.rowwise(largest, f"id BIGINT, class INT, name STRING, rings ARRAY<{S.POINTS}>", run)
    return _shape(at, "label", id=F.col("id"), kind=F.col("class"), name=F.col("name"), rings=F.col("rings"))


def node_shapes(nodes: DataFrame) -> DataFrame:
    """Labels of places and points of interest: one scan, two derived columns."""
    t = F.col("tags")
    n = nodes.where(F.size("tags") > 0).withColumns({"place": C.classify_place(t), "poi": C.classify_poi(t), "called": C.name_of(t)})
    n = n.where("(place IS NOT NULL AND called IS NOT NULL) OR poi IS NOT NULL").withColumn("at", F.array(F.array(F.struct(M.mercator_x(F.col("lon")).alias("x"), M.mercator_y(F.col("lat")).alias("y")))))
    labels = _shape(n.where("place IS NOT NULL AND called IS NOT NULL"), "label", id=F.col("id"), kind=F.col("place"), name=F.col("called"), rings=F.col("at"))
    return labels.unionByName(_shape(n.where("poi IS NOT NULL"), "poi", id=F.col("id"), kind=F.col("poi"), rings=F.col("at")))


@dataclass(frozen=True)
class RelationFeature:
    """Relations whose member ways become merged lines for coarse zooms: which relations it claims, the road kind of its lines, kinds of which a relation needs one member (all its members then count), and whether lines that run along longer ones go."""

    kind: int
    claims: Callable[[Column], Column]
    needs: tuple[int, ...] = ()
    thin: bool = False


#: Routes with a motorway, and national borders. Others can be added; a kind below 16 tells features apart.
FEATURES = (
    RelationFeature(12, lambda tags: C.has(tags, "route", "road"), needs=(0, 16), thin=True),
    RelationFeature(15, lambda tags: C.has(tags, "boundary", "administrative") & C.has(tags, "admin_level", "2")),
)


def feature_roads(nodes: DataFrame, ways: DataFrame, relations: DataFrame, features: tuple[RelationFeature, ...] = FEATURES) -> DataFrame:
    """All features share one scan of relations, one of ways and one of nodes. Lines of a feature that meet end to end are joined to strokes, whichever relation they come from; a stroke's id is its smallest way's, with the feature in the last four bits."""
    t = F.col("tags")
    which = F.array_compact(F.array(*(F.when(f.claims(t), f.kind) for f in features)))
    claimed = staged(relations.withColumn("feature", F.explode(which)).select("id", "members", "feature"), "claimed")
    members = N.members_of(claimed.select("id", "members").dropDuplicates(["id"])).join(claimed.select(F.col("id").alias("rel_id"), "feature"), "rel_id")
    kinds = ways.select(F.col("id").alias("way_id"), C.classify_way(t)["kind"].alias("kind"), "refs")
    m = staged(members.join(kinds, "way_id").select("rel_id", "feature", "way_id", "kind", "refs"), "members")
    chosen = None
    for f in features:
        one = m.where(F.col("feature") == f.kind)
        one = N.with_any(one, "rel_id", F.col("kind").isin(*f.needs)) if f.needs else one
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = chosen.select("feature", "way_id", "refs").dropDuplicates(["feature", "way_id"])
    chosen = staged(chosen.withColumn("feature", F.col("feature").cast("bigint")).withColumn("key", F.struct("feature", "way_id")), "chosen")
    lines = vertices(chosen.select("key", F.posexplode("refs").alias("pos", "node_id")), nodes, "key").select("key.*", F.col("points").alias("coords")).where("size(coords) >= 2")
    chained = staged(S.strokes(lines, "feature").select((F.col("stroke") * 16 + F.col("feature")).alias("id"), "coords", "feature"), "strokes")
    out = None
    for f in features:
        one = chained.where(F.col("feature") == f.kind)
        one = S.without_parallels(one) if f.thin else one
        shaped = _shape(one, "road", id=F.col("id"), kind=F.lit(f.kind), lanes_fwd=F.lit(1), lanes_bwd=F.lit(1), rings=F.array("coords"), aggregated=F.lit(True))
        out = shaped if out is None else out.unionByName(shaped)
    return out


def water_shapes(water: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Water polygons united cell by cell, on layer -1; inside a box of metres if one is given."""
    joined = S.united(S.clipped_to_box(water, box) if box else water, 1_000_000.0)
    return _shape(joined, "area", id=(F.col("cx") * 1_000_000 + F.col("cy") * 1000 + F.col("part")), kind=F.lit(0), layer=F.lit(-1), rings=F.col("rings"))


def forest_shapes(areas: DataFrame, config: TileBuildConfig) -> DataFrame:
    """Forests burned to pixels and outlined again, for coarse zooms."""
    scale = (256 << config.mask_zoom) / M.EDGE / 256
    blobs = S.outlines(S.burned(areas.where("kind = 1"), scale), scale)
    return _shape(blobs, "area", id=(F.col("by").cast("bigint") * 1_000_000 + F.col("bx") * 1000 + F.col("blob")), kind=F.lit(1), rings=F.col("rings"), aggregated=F.lit(True))


def extract_bbox(nodes: DataFrame) -> tuple[float, float, float, float]:
    """min lon, min lat, max lon, max lat of all nodes; zeros if there are none."""
    return tuple(nodes.agg(*(F.coalesce(f(k), F.lit(0.0)) for f in (F.min, F.max) for k in ("lon", "lat"))).first())


def box_in_metres(box: tuple[float, float, float, float], margin: float) -> tuple[float, float, float, float]:
    """A box of degrees, widened by a share of its sides, in Mercator metres."""
    import math

    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    x = lambda lon: math.radians(lon) * M.RADIUS
    y = lambda lat: M.RADIUS * math.log(math.tan(math.pi / 4 + math.radians(max(-M.MAX_LAT, min(M.MAX_LAT, lat))) / 2))
    return x(box[0] - w), y(box[1] - h), x(box[2] + w), y(box[3] + h)


def shapes(tables: dict[str, DataFrame], config: TileBuildConfig = TileBuildConfig(), water: DataFrame | None = None) -> DataFrame:
    nodes, ways, relations = tables["nodes"], tables["ways"], tables["relations"]
    plain = staged(way_shapes(nodes, ways).unionByName(relation_shapes(nodes, ways, relations)), "shapes")
    areas = plain.where("shape = 'area'")
    every = plain.unionByName(area_labels(areas)).unionByName(node_shapes(nodes)).unionByName(forest_shapes(areas, config)).unionByName(feature_roads(nodes, ways, relations))
    if water is not None:
        box = box_in_metres(extract_bbox(nodes), 0.1) if config.clip_water_to_extract_bbox else None
        every = every.unionByName(water_shapes(water, box))
    return every


def tiles(tables: dict[str, DataFrame], config: TileBuildConfig = TileBuildConfig(), water: DataFrame | None = None) -> DataFrame:
    """tile_id, z, tx, ty, data."""
    recs = S.records(shapes(tables, config, water), config.zooms, extent=config.extent, simplify_px=config.simplify_px, render_px=config.tile_render_px, agg_max_zoom=config.agg_max_zoom, road_agg_max_zoom=config.road_agg_max_zoom)
    return S.payloads(recs, config.extent)


def build(spark: SparkSession, osm: str, pmtiles: str, config: TileBuildConfig = TileBuildConfig(), water: str | None = None, keep: str | None = None) -> Header:
    """The archive of a PBF file, and of a water shapefile if one is given. keep: a folder in which the extract's tables stay for later builds."""
    tables = read_extract(spark, osm, keep)
    made = staged(tiles(tables, config, read_water(spark, water) if water else None), "tiles")
    zooms = sorted(r.z for r in made.select("z").distinct().collect())
    bounds = tuple(int(v * 1e7) for v in extract_bbox(tables["nodes"]))
    return write_archive(made.select("tile_id", "data"), pmtiles, new_path(spark, "parts"), zooms=zooms, bounds_e7=bounds)
