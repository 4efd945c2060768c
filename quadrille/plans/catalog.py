"""A query for each relational operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds
from ..functions import mercator as M
from ..functions import tags as C
from ..functions import tileid as I
from ..functions.kinds import ZOOMS, kind_dimension
from ..operators import archive as A
from ..operators import network as N
from ..operators import sequences as S
from .projection import MEMBERS_SQL, NODES_SQL, POINTS_SQL, REFS_SQL, REQUESTS_SQL, WAYS_SQL, nodes, points, relations, requests, table, way_refs, way_tags, ways

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def zoomed(df: DataFrame) -> DataFrame:
    return N.across_zooms(df, ZOOMS)


ZOOMS_SQL = "zooms AS (SELECT unnest([4, 6, 8, 10, 12, 14]) AS z)"
TILES_SQL = POINTS_SQL + ", " + ZOOMS_SQL + """, tiles AS (SELECT id, z, greatest(0, least(floor((x + pi() * 6378137.0) / (2 * pi() * 6378137.0) * (1 << z)), (1 << z) - 1))::INT AS tx,
  greatest(0, least(floor((pi() * 6378137.0 - y) / (2 * pi() * 6378137.0) * (1 << z)), (1 << z) - 1))::INT AS ty FROM points, zooms)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, tx, ty: nodes in the tiles of all zooms."""
    p = zoomed(points(spark, sf_dir))
    return p.select("id", "z", M.tile_x(c("x"), c("z")).alias("tx"), M.tile_y(c("y"), c("z")).alias("ty"))


def distinct_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("z", "tx", "ty").distinct()


DISTINCT_SQL = TILES_SQL + ", t AS (SELECT DISTINCT z, tx, ty FROM tiles)"


@query(f"WITH {POINTS_SQL} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM points")
def mercator_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {POINTS_SQL} SELECT id, round(degrees(x / 6378137.0), 7) AS lon, round(degrees(atan(sinh(y / 6378137.0))), 7) AS lat FROM points")
def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.round(M.lon_of(c("x")), 7).alias("lon"), F.round(M.lat_of(c("y")), 7).alias("lat"))


@query(f"WITH {NODES_SQL} SELECT id, round(lon * 1e7)::INT AS lon_e7, round(lat * 1e7)::INT AS lat_e7, round((round(lon * 1e7) / 1e7 - lon) * 1e7, 1) + 0.0 AS error FROM nodes")
def pack_e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return n.select("id", M.pack_e7(c("lon")).alias("lon_e7"), M.pack_e7(c("lat")).alias("lat_e7"), (F.round((M.unpack_e7(M.pack_e7(c("lon"))) - c("lon")) * 1e7, 1) + 0.0).alias("error"))


@query(f"WITH {TILES_SQL} SELECT * FROM tiles")
def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir)


@query(f"WITH {TILES_SQL} SELECT z, tx, ty, count(*) AS nodes FROM tiles GROUP BY ALL")
def tile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).groupBy("z", "tx", "ty").agg(F.count("*").alias("nodes"))


@query(f"""WITH {DISTINCT_SQL}, e AS (SELECT *, 2 * pi() * 6378137.0 / (1 << z) AS edge, pi() * 6378137.0 AS half FROM t)
SELECT z, tx, ty, round(tx * edge - half, 2) AS min_x, round((tx + 1) * edge - half, 2) AS max_x, round(half - (ty + 1) * edge, 2) AS min_y, round(half - ty * edge, 2) AS max_y FROM e""")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.tile_bounds(c("tx"), c("ty"), c("z"))
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", *(F.round(v, 2).alias(k) for k, v in b.items()))


@query(f"WITH {DISTINCT_SQL} SELECT z, tx, ty, z - 1 AS pz, tx >> 1 AS px, ty >> 1 AS py FROM t WHERE z > 0")
def tile_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).where("z > 0").select("z", "tx", "ty", (c("z") - 1).alias("pz"), M.parent(c("tx")).alias("px"), M.parent(c("ty")).alias("py"))


@query(f"WITH {DISTINCT_SQL} SELECT z, tx, ty, 2 * tx + dx AS x, 2 * ty + dy AS y FROM t, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)")
def tile_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", F.explode(M.children(c("tx"), c("ty"))).alias("s")).select("z", "tx", "ty", "s.*")


_MORTON = "list_sum([((tx >> k) & 1)::BIGINT << (2 * k) for k in range(16)]) + list_sum([((ty >> k) & 1)::BIGINT << (2 * k + 1) for k in range(16)])"
_MORTON_SQL = DISTINCT_SQL + f", m AS (SELECT *, ({_MORTON})::BIGINT AS m FROM t)"


@query(f"WITH {_MORTON_SQL} SELECT z, tx, ty, m AS morton FROM m")
def morton_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", I.morton(c("tx"), c("ty")).alias("morton"))


@query(f"WITH {_MORTON_SQL} SELECT z, tx, ty, ((1::BIGINT << (2 * z)) - 1) // 3 + m AS tile_id FROM m")
def build_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", I.build_id(c("tx"), c("ty"), c("z")).alias("tile_id"))


@query(f"WITH {_MORTON_SQL} SELECT z, tx, ty, CASE WHEN z >= 6 THEN m >> (2 * (z - 6)) ELSE m << (2 * (6 - z)) END AS bucket FROM m")
def bucket_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", I.bucket(I.morton(c("tx"), c("ty")), c("z"), 6).alias("bucket"))


@query(f"WITH {_MORTON_SQL} SELECT ((1::BIGINT << (2 * z)) - 1) // 3 + m AS tile_id, z, tx, ty FROM m")
def id_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = distinct_tiles(spark, sf_dir).select(I.build_id(c("tx"), c("ty"), c("z")).alias("tile_id")).withColumn("z", I.zoom_of_id(c("tile_id")))
    m = c("tile_id") - I.below(c("z"))
    return ids.select("tile_id", "z", I.morton_x(m).alias("tx"), I.morton_y(m).alias("ty"))


@query(f"""WITH RECURSIVE {DISTINCT_SQL}, h AS (
  SELECT z, tx, ty, z - 1 AS k, tx::BIGINT AS x, ty::BIGINT AS y, 0::BIGINT AS d FROM t
  UNION ALL
  SELECT z, tx, ty, k - 1, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - y ELSE y END) ELSE x END, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - x ELSE x END) ELSE y END, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, 1::BIGINT << k AS s, ((x >> k) & 1)::BIGINT AS rx, ((y >> k) & 1)::BIGINT AS ry FROM h WHERE k >= 0))
SELECT z, tx, ty, d AS hilbert, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM h WHERE k = -1""")
def hilbert_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_tiles(spark, sf_dir).select("z", "tx", "ty", I.hilbert(c("tx"), c("ty"), c("z")).alias("hilbert"), I.archive_id(c("tx"), c("ty"), c("z")).alias("tile_id"))


_LOCAL_SQL = POINTS_SQL + ", " + REFS_SQL + """, local AS (SELECT way_id, pos, least(8192, greatest(0, round((fx - floor(fx)) * 8192)))::INT AS lx, least(8192, greatest(0, round((fy - floor(fy)) * 8192)))::INT AS ly
  FROM (SELECT way_id, pos, (x + pi() * 6378137.0) / (2 * pi() * 6378137.0) * 16384 AS fx, (pi() * 6378137.0 - y) / (2 * pi() * 6378137.0) * 16384 AS fy FROM refs JOIN points ON node_id = id))"""


def local_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, lx, ly: vertices in units of their base tile."""
    p = points(spark, sf_dir).select(c("id").alias("node_id"), "x", "y")
    z = lit(14)
    fx, fy = M.fractional_x(c("x"), z), M.fractional_y(c("y"), z)
    return way_refs(spark, sf_dir).join(p, "node_id").select("way_id", "pos", M.quantize((fx - F.floor(fx)) * M.EXTENT).alias("lx"), M.quantize((fy - F.floor(fy)) * M.EXTENT).alias("ly"))


@query(f"""WITH {_LOCAL_SQL}, d AS (SELECT way_id, pos, lx - lag(lx, 1, 0) OVER w AS dx, ly - lag(ly, 1, 0) OVER w AS dy FROM local WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, pos, xor(dx << 1, dx >> 31) & 65535 AS zx, xor(dy << 1, dy >> 31) & 65535 AS zy FROM (SELECT way_id, pos, dx::BIGINT AS dx, dy::BIGINT AS dy FROM d)""".replace("dx << 1", "dx * 2").replace("dy << 1", "dy * 2"))
def zigzag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.deltas(local_vertices(spark, sf_dir), "way_id", "pos", ["lx", "ly"])
    return d.select("way_id", "pos", I.zigzag16(c("d_lx")).cast("bigint").alias("zx"), I.zigzag16(c("d_ly")).cast("bigint").alias("zy"))


@query(f"WITH {_LOCAL_SQL} SELECT way_id, pos, lx::BIGINT AS lx, ly::BIGINT AS ly FROM local")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.deltas(local_vertices(spark, sf_dir), "way_id", "pos", ["lx", "ly"]).select("way_id", "pos", *(I.unzigzag16(I.zigzag16(c(k))).alias(k) for k in ("d_lx", "d_ly")))
    return S.undeltas(d, "way_id", "pos", ["lx", "ly"]).select("way_id", "pos", "lx", "ly")


@query(f"WITH {WAYS_SQL} SELECT id, 'road' AS shape, kind, priority AS name FROM ways")
def classify_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).select("id", C.classify_way(c("tags")).alias("s"), C.name_of(c("tags")).alias("name")).select("id", "s.shape", "s.kind", "name")


@query(f"WITH {WAYS_SQL} SELECT id FROM ways WHERE status = 'O' OR kind IN (0, 1)")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).where(C.matches(c("tags"), (("bridge", ()), ("highway", ("motorway", "trunk"))))).select("id")


@query(f"WITH {WAYS_SQL} SELECT id, CASE status WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS structure, CASE status WHEN 'O' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS layer FROM ways")
def structure_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).select("id", C.structure_of(c("tags")).alias("structure"), C.way_layer(c("tags")).alias("layer"))


def part_tags(spark: SparkSession, sf_dir: str, *pairs: tuple[str, Column]) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(*(F.struct(lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs)).alias("tags"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN greatest(p_size % 7, 1) WHEN 1 THEN 0 ELSE greatest((p_size % 7 + 1) // 2, 1) END::INT AS forward,
  CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN greatest(p_size % 7, 1) ELSE greatest(p_size % 7 // 2, 1) END::INT AS backward FROM part""")
def lanes_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.when(c("p_size") % 3 == 0, "yes").when(c("p_size") % 3 == 1, "-1").otherwise("no")
    return part_tags(spark, sf_dir, ("lanes", c("p_size") % 7), ("oneway", way)).select("p_partkey", C.lanes_of(c("tags")).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1 ELSE greatest(1, least(255, round(p_size * 6.5::DOUBLE)))::INT END AS floors FROM part")
def floors_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(c("p_size") % 5 == 0, lit("none")).otherwise((c("p_size") * lit(6.5)).cast("string"))
    return part_tags(spark, sf_dir, ("building:levels", value)).select("p_partkey", C.floors_of(c("tags")).alias("floors"))


@query("""SELECT s_suppkey, s_nationkey % 8 AS place, CASE s_nationkey % 8 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 12 WHEN 5 THEN 13 END AS min_zoom FROM supplier WHERE s_nationkey % 8 < 6""")
def classify_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(lit, ("city", "town", "village", "suburb", "hamlet", "locality", "water", "park")))
    tags = F.array(F.struct(lit("place").alias("k"), F.element_at(names, c("s_nationkey") % 8 + 1).alias("v")))
    placed = table(spark, sf_dir, "supplier").select("s_suppkey", C.classify_place(tags).alias("place")).where("place IS NOT NULL")
    dim = kind_dimension(spark).where("shape = 'label'").select(c("ordinal").alias("place"), "min_zoom")
    return placed.join(F.broadcast(dim), "place").select("s_suppkey", "place", "min_zoom")


def _gate(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    w = zoomed(ways(spark, sf_dir).select("id", C.classify_way(c("tags"))["kind"].alias("kind")))
    dim = kind_dimension(spark).where("shape = 'road'").select(c("ordinal").alias("kind"), column)
    return w.join(F.broadcast(dim), "kind").where(c("z") >= c(column)).groupBy("z", "kind").agg(F.count("*").alias("ways"))


@query(f"WITH {WAYS_SQL}, {ZOOMS_SQL} SELECT z, kind, count(*) AS ways FROM ways, zooms WHERE z >= CASE WHEN kind <= 2 THEN 10 WHEN kind = 3 THEN 12 ELSE 14 END GROUP BY ALL")
def kind_zoom_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir, "min_zoom")


@query(f"WITH {WAYS_SQL}, {ZOOMS_SQL} SELECT z, kind, count(*) AS ways FROM ways, zooms WHERE z >= CASE WHEN kind <= 2 THEN 10 WHEN kind = 3 THEN 13 ELSE 15 END GROUP BY ALL")
def display_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir, "display_min_zoom")


@query(f"WITH {NODES_SQL}, {REFS_SQL} SELECT way_id, pos, node_id, lon, lat FROM refs JOIN nodes ON node_id = id")
def resolve_way_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve(way_refs(spark, sf_dir), nodes(spark, sf_dir))


@query(f"WITH {MEMBERS_SQL} SELECT m.rel_id, m.pos, m.way_id, m.is_hole, count(l_partkey) AS refs FROM members m LEFT JOIN lineitem ON l_orderkey = way_id GROUP BY ALL HAVING count(l_partkey) > 0")
def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = N.members_of(relations(spark, sf_dir))
    refs = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("way_id")).agg(F.count("l_partkey").alias("refs"))
    return m.join(refs, "way_id").select("rel_id", "pos", "way_id", "is_hole", "refs")


@query("""WITH matched AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)),
wanted AS (SELECT id FROM matched UNION SELECT id + 1 FROM matched WHERE id % 10 = 0)
SELECT DISTINCT o_orderkey AS way_id FROM orders WHERE o_custkey IN (SELECT id FROM wanted) AND o_custkey IN (SELECT c_custkey FROM customer)""")
def super_relation_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir)
    return N.super_relation_ways(r, r.where("segment = 'BUILDING'").select("id"))


@query(f"WITH {NODES_SQL}, {REFS_SQL}, {WAYS_SQL} SELECT id, lon, lat FROM nodes WHERE id IN (SELECT node_id FROM refs WHERE way_id IN (SELECT id FROM ways))")
def referenced_nodes_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).join(road_refs(spark, sf_dir).select(c("node_id").alias("id")), "id", "left_semi")


@query(f"WITH {NODES_SQL}, {REFS_SQL}, {WAYS_SQL} SELECT id FROM nodes WHERE id NOT IN (SELECT node_id FROM refs WHERE way_id IN (SELECT id FROM ways)) UNION ALL SELECT node_id FROM (SELECT DISTINCT node_id + (way_id % 3) * 1000000 AS node_id FROM refs) WHERE node_id NOT IN (SELECT id FROM nodes)")
def missing_nodes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without references, and references (two thirds of them moved) without nodes."""
    refs, every = road_refs(spark, sf_dir), nodes(spark, sf_dir).select("id")
    moved = refs.select((c("node_id") + c("way_id") % 3 * 1_000_000).alias("id")).distinct()
    return every.join(refs.select(c("node_id").alias("id")), "id", "left_anti").unionByName(moved.join(every, "id", "left_anti"))


def road_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.refs_of(ways(spark, sf_dir).where(C.classify_way(c("tags"))["shape"] == "road"))


_JUNCTION_SQL = REFS_SQL + ", junctions AS (SELECT node_id, count(*) AS refs FROM refs GROUP BY node_id HAVING count(*) >= 2)"


@query(f"WITH {_JUNCTION_SQL} SELECT * FROM junctions")
def junction_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.junctions(road_refs(spark, sf_dir))


@query(f"""WITH {_JUNCTION_SQL}, ends AS (SELECT way_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b FROM refs GROUP BY way_id)
SELECT way_id, CASE WHEN a IN (SELECT node_id FROM junctions) THEN 0 ELSE 1 END AS start_state, CASE WHEN b IN (SELECT node_id FROM junctions) THEN 0 ELSE 1 END AS end_state FROM ends""")
def edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = road_refs(spark, sf_dir)
    ends = refs.groupBy("way_id").agg(F.min_by("node_id", "pos").alias("a"), F.max_by("node_id", "pos").alias("b"))
    j = N.junctions(refs).select("node_id")
    at = lambda side: j.select(c("node_id").alias(side), lit(True).alias(f"j_{side}"))
    both = ends.join(at("a"), "a", "left").join(at("b"), "b", "left")
    state = lambda side: C.edge_state(F.coalesce(c(f"j_{side}"), lit(False)), lit(False))
    return both.select("way_id", state("a").alias("start_state"), state("b").alias("end_state"))


@query(f"WITH {NODES_SQL} SELECT coalesce(min(lon), 0) AS min_lon, coalesce(min(lat), 0) AS min_lat, coalesce(max(lon), 0) AS max_lon, coalesce(max(lat), 0) AS max_lat FROM nodes")
def extract_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda f, k: F.coalesce(f(k), lit(0.0))
    return nodes(spark, sf_dir).agg(none(F.min, "lon").alias("min_lon"), none(F.min, "lat").alias("min_lat"), none(F.max, "lon").alias("max_lon"), none(F.max, "lat").alias("max_lat"))


@query("SELECT 'node' AS kind, min(p_partkey) AS first_id, max(p_partkey) AS max_id, count(*) AS n FROM part UNION ALL SELECT 'way', min(o_orderkey), max(o_orderkey), count(*) FROM orders UNION ALL SELECT 'relation', min(c_custkey), max(c_custkey), count(*) FROM customer")
def id_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("node", "part", "p_partkey"), ("way", "orders", "o_orderkey"), ("relation", "customer", "c_custkey"))
    out = None
    for kind, name, key in parts:
        one = table(spark, sf_dir, name).agg(F.min(key).alias("first_id"), F.max(key).alias("max_id"), F.count("*").alias("n")).select(lit(kind).alias("kind"), "*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT o_custkey AS rel_id, o_orderkey AS way_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def route_exists_motorway(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("rel_id"), c("o_orderkey").alias("way_id"), "o_orderpriority")
    return N.with_any(o, "rel_id", c("o_orderpriority") == "1-URGENT").select("rel_id", "way_id")


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT DISTINCT l_partkey AS id FROM lineitem)")
def dense_rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dense_ids(table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("id")), "id", "rank")


_LINES_SQL = POINTS_SQL + ", " + REFS_SQL + ", v AS (SELECT way_id, pos, x, y FROM refs JOIN points ON node_id = id), ok AS (SELECT way_id FROM v GROUP BY way_id HAVING count(*) >= 2), boxes AS (SELECT way_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v WHERE way_id IN (SELECT way_id FROM ok) GROUP BY way_id)"


def way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.placed(way_refs(spark, sf_dir), nodes(spark, sf_dir))


def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lines(way_points(spark, sf_dir))


@query(f"WITH {_LINES_SQL}, {ZOOMS_SQL} SELECT z, count(*) AS shapes FROM boxes, zooms GROUP BY z")
def zoom_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoomed(way_lines(spark, sf_dir)).groupBy("z").agg(F.count("*").alias("shapes"))


_FX, _FY = "(({0} + pi() * 6378137.0) / (2 * pi() * 6378137.0) * (1 << z))", "((pi() * 6378137.0 - {0}) / (2 * pi() * 6378137.0) * (1 << z))"
_COVER_SQL = _LINES_SQL + ", " + ZOOMS_SQL + f", cells AS (SELECT way_id, z, floor({_FX.format('min_x')})::INT AS x0, floor({_FX.format('max_x')})::INT AS x1, floor({_FY.format('max_y')})::INT AS y0, floor({_FY.format('min_y')})::INT AS y1 FROM boxes, zooms)"


@query(f"WITH {_COVER_SQL}, tx AS (SELECT *, unnest(range(x0, x1 + 1))::INT AS tx FROM cells), ty AS (SELECT *, unnest(range(y0, y1 + 1))::INT AS ty FROM tx) SELECT z, tx, ty, count(*) AS ways FROM ty GROUP BY ALL")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = zoomed(way_lines(spark, sf_dir).select("way_id", G.bbox(c("coords")).alias("b")).select("way_id", "b.*"))
    return N.cover(boxes, "min_x", "min_y", "max_x", "max_y").groupBy("z", "tx", "ty").agg(F.count("*").alias("ways"))


@query(f"""WITH {_LINES_SQL}, segs AS (SELECT way_id, (row_number() OVER w - 1)::INT AS seg, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM v WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
s AS (SELECT *, 14 AS z FROM segs WHERE ex IS NOT NULL),
f AS (SELECT way_id, seg, {_FX.format('ax')} AS fax, {_FY.format('ay')} AS fay, {_FX.format('ex')} AS fbx, {_FY.format('ey')} AS fby FROM s),
tx AS (SELECT *, unnest(range(floor(least(fax, fbx))::BIGINT, floor(greatest(fax, fbx))::BIGINT + 1))::INT AS tx FROM f),
ty AS (SELECT *, unnest(range(floor(least(fay, fby))::BIGINT, floor(greatest(fay, fby))::BIGINT + 1))::INT AS ty FROM tx),
l AS (SELECT way_id, seg, tx, ty, fax - tx AS ax, fay - ty AS ay, fbx - tx AS ex, fby - ty AS ey FROM ty),
p AS (SELECT *, greatest(0, CASE WHEN ex > ax THEN (0 - ax) / (ex - ax) WHEN ex < ax THEN (1 - ax) / (ex - ax) ELSE 0 END, CASE WHEN ey > ay THEN (0 - ay) / (ey - ay) WHEN ey < ay THEN (1 - ay) / (ey - ay) ELSE 0 END) AS t0,
 least(1, CASE WHEN ex > ax THEN (1 - ax) / (ex - ax) WHEN ex < ax THEN (0 - ax) / (ex - ax) ELSE 1 END, CASE WHEN ey > ay THEN (1 - ay) / (ey - ay) WHEN ey < ay THEN (0 - ay) / (ey - ay) ELSE 1 END) AS t1 FROM l)
SELECT tx, ty, count(*) AS pieces, count(*) FILTER (t0 > 0) AS cut_starts, count(*) FILTER (t1 < 1) AS cut_ends, sum(round(greatest(0, least(8192, (ax + (ex - ax) * t0) * 8192))))::BIGINT // 1000 AS kilo_x FROM p WHERE t0 <= t1 GROUP BY ALL""")
def line_clip_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = N.clip_to_tiles(N.segments(way_lines(spark, sf_dir)), 14)
    return pieces.groupBy("tx", "ty").agg(F.count("*").alias("pieces"), F.count_if("cut_start").alias("cut_starts"), F.count_if("cut_end").alias("cut_ends"), F.floor(F.sum("x0") / 1000).cast("bigint").alias("kilo_x"))


_LENGTH_SQL = _LINES_SQL + """, segs AS (SELECT way_id, x, y, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM v WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
lengths AS (SELECT way_id, round(sum(sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y))) / cosh(avg(y) / 6378137.0))::BIGINT AS metres FROM segs WHERE ex IS NOT NULL GROUP BY way_id)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return way_lines(spark, sf_dir).select("way_id", F.round(G.ground_length(c("coords"))).cast("bigint").alias("metres"))


@query(f"WITH {_LENGTH_SQL} SELECT * FROM lengths")
def line_length_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(spark, sf_dir)


@query(f"WITH {_LENGTH_SQL}, {WAYS_SQL} SELECT kind, max(metres) AS metres, arg_max(way_id, [metres, way_id]) AS way_id FROM lengths JOIN ways ON id = way_id GROUP BY kind")
def longest_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ways(spark, sf_dir).select(c("id").alias("way_id"), C.classify_way(c("tags"))["kind"].alias("kind"))
    return lengths(spark, sf_dir).join(kinds, "way_id").groupBy("kind").agg(F.max("metres").alias("metres"), F.max_by("way_id", F.struct("metres", "way_id")).alias("way_id"))


@query(f"""WITH {_LINES_SQL}, big AS (SELECT way_id FROM v GROUP BY way_id HAVING count(*) >= 3), n AS (SELECT way_id, pos, x - 15473550 AS x, y - 4163880 AS y FROM v WHERE way_id IN (SELECT way_id FROM big)),
e AS (SELECT way_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM n WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, round(abs(sum(x * ey - ex * y)) / 2)::BIGINT AS area FROM e GROUP BY way_id""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.transform("coords", lambda p: F.struct((p["x"] - 15473550).alias("x"), (p["y"] - 4163880).alias("y")))  # a near origin, so that little is cancelled
    return way_lines(spark, sf_dir).where(F.size("coords") >= 3).select("way_id", F.round(G.ring_area(near)).cast("bigint").alias("area"))


@query(f"WITH {_LINES_SQL} SELECT way_id, round(min_x, 3) AS min_x, round(min_y, 3) AS min_y, round(max_x, 3) AS max_x, round(max_y, 3) AS max_y FROM boxes")
def ring_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = way_lines(spark, sf_dir).select("way_id", G.bbox(c("coords")).alias("b"))
    return b.select("way_id", *(F.round(f"b.{k}", 3).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")))


_ENDS_SQL = REFS_SQL + ", " + WAYS_SQL + """, first_last AS (SELECT way_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b, count(*) AS n FROM refs GROUP BY way_id HAVING count(*) >= 2),
ends AS (SELECT kind, id AS road, 0 AS side, a % 200 * 6 AS x, a // 200 * 6 AS y, (n % 5 + 1)::INT AS lanes FROM ways JOIN first_last ON id = way_id UNION ALL SELECT kind, id, 1, b % 200 * 6, b // 200 * 6, (n % 5 + 1)::INT FROM ways JOIN first_last ON id = way_id)"""


def road_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, road, side, x, y, lanes on a grid of six units for each node."""
    w = ways(spark, sf_dir).where(F.size("refs") >= 2)
    end = lambda side, at: F.struct(lit(side).alias("side"), (at % 200 * 6).alias("x"), (F.floor(at / 200) * 6).alias("y"))
    both = F.array(end(0, F.get("refs", lit(0))), end(1, F.element_at("refs", -1)))
    return w.select(C.classify_way(c("tags"))["kind"].alias("kind"), c("id").alias("road"), F.explode(both).alias("e"), (F.size("refs") % 5 + 1).alias("lanes")).select("kind", "road", "e.*", "lanes")


@query(f"WITH {_ENDS_SQL} SELECT e.kind, e.road, e.side, e.lanes, greatest(any_value(e.lanes), coalesce(max(o.lanes), any_value(e.lanes))) AS blended FROM ends e LEFT JOIN ends o ON e.kind = o.kind AND e.road <> o.road AND abs(e.x - o.x) <= 8 AND abs(e.y - o.y) <= 8 GROUP BY e.kind, e.road, e.side, e.lanes")
def width_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.blend_widths(road_ends(spark, sf_dir), 8).select("kind", "road", "side", "lanes", "blended")


@query(f"""WITH {WAYS_SQL}, {REFS_SQL}, w AS (SELECT custkey, CASE status WHEN 'O' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS layer, count(*) AS n FROM ways JOIN refs ON way_id = id GROUP BY ALL)
SELECT custkey, arg_max(layer, [n, layer]) AS layer FROM w GROUP BY custkey""")
def layer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).select("custkey", C.way_layer(c("tags")).alias("layer"), F.size("refs").alias("n"))
    return N.layer_by_weight(w, "custkey", "layer", "n")


def tile_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, data: documents as tiles, four ids to a text, so that runs occur."""
    d = table(spark, sf_dir, "documents").select((c("doc_id") * 4).alias("base"), F.encode(F.coalesce("text", lit("")), "UTF-8").alias("data"))
    return d.select(F.explode(F.transform(F.array(*map(lit, (0, 1, 2))), lambda k: c("base") + k)).alias("tile_id"), "data")


_CONTENT_SQL = """tiles AS (SELECT doc_id * 4 + unnest([0, 1, 2]) AS tile_id, coalesce(text, '') AS data FROM documents),
contents AS (SELECT md5(data) AS content, min(tile_id) AS first_id, strlen(any_value(data))::BIGINT AS length, count(*) AS tiles FROM tiles GROUP BY md5(data)),
placed AS (SELECT *, (sum(length) OVER (ORDER BY first_id) - length)::BIGINT AS "offset" FROM contents),
marked AS (SELECT tile_id, "offset", length, tile_id - row_number() OVER (PARTITION BY "offset" ORDER BY tile_id) AS island FROM tiles JOIN placed ON md5(data) = content),
entries AS (SELECT min(tile_id) AS tile_id, "offset", length, count(*) AS run_length FROM marked GROUP BY "offset", length, island)"""


@query(f"WITH {_CONTENT_SQL} SELECT content, first_id, length, tiles FROM contents")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contents(tile_data(spark, sf_dir))


@query(f"WITH {_CONTENT_SQL} SELECT content, first_id, length, \"offset\" FROM placed")
def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.layout(A.contents(tile_data(spark, sf_dir))).select("content", "first_id", "length", "offset")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tile_data(spark, sf_dir)
    return A.directory(t, A.layout(A.contents(t)))


@query(f"WITH {_CONTENT_SQL} SELECT * FROM entries")
def directory_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir)


@query(f"""WITH {_CONTENT_SQL}, l AS (SELECT *, tile_id // 1024 AS leaf FROM entries) SELECT leaf, tile_id, tile_id - lag(tile_id, 1, 0) OVER w AS d_id, run_length, length, CASE WHEN lag("offset" + length) OVER w = "offset" THEN 0 ELSE "offset" + 1 END AS offset_code FROM l WINDOW w AS (PARTITION BY leaf ORDER BY tile_id)""")
def directory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.directory_columns(entries(spark, sf_dir), F.floor(c("tile_id") / 1024))


@query(f"WITH {_CONTENT_SQL} SELECT sum(run_length)::BIGINT AS addressed, count(*) AS entries, count(DISTINCT \"offset\") AS contents FROM entries")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stats(entries(spark, sf_dir))


@query(f"WITH {_CONTENT_SQL}, {REQUESTS_SQL}, q AS (SELECT event_id, (event_id * 7919) % 5000 AS q FROM requests) SELECT event_id, q, coalesce(tile_id, -1) AS tile_id, coalesce(\"offset\", -1) AS \"offset\", coalesce(length, -1) AS length, coalesce(run_length, -1) AS run_length FROM q LEFT JOIN entries ON q >= tile_id AND q < tile_id + run_length")
def asof_tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = requests(spark, sf_dir).select("event_id", (c("event_id") * 7919 % 5000).alias("q"))
    return A.find(q, entries(spark, sf_dir)).select("event_id", "q", *(F.coalesce(k, lit(-1)).alias(k) for k in ("tile_id", "offset", "length", "run_length")))


_ANCESTOR_SQL = DISTINCT_SQL + ", " + REQUESTS_SQL + """, asked AS (SELECT event_id AS request, 16 AS z, (58000 + event_id % 200)::INT AS x, (25800 + k)::INT AS y FROM requests),
up AS (SELECT *, unnest(range(0, 17)) AS k FROM asked), hits AS (SELECT request, u.z, x, y, t.z AS from_z, tx AS from_x, ty AS from_y FROM up u JOIN t ON t.z = u.z - k AND tx = x >> k AND ty = y >> k)"""


@query(f"WITH {_ANCESTOR_SQL} SELECT request, z, x, y, max(from_z) AS from_z, arg_max(from_x, from_z) AS from_x, arg_max(from_y, from_z) AS from_y FROM hits GROUP BY ALL")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).select(c("event_id").alias("request"), lit(16).alias("z"), (c("event_id") % 200 + 58000).cast("int").alias("x"), (c("k") + 25800).alias("y"))
    return A.nearest_ancestor(asked, distinct_tiles(spark, sf_dir).select("z", c("tx").alias("x"), c("ty").alias("y")), 14)


@query(f"WITH {REQUESTS_SQL}, levels AS (SELECT unnest([4, 6, 8, 10, 12, 14]) AS l) SELECT event_id, arg_min(l, [abs(l - (4 + k % 11 + 0.5::DOUBLE)), l])::INT AS level FROM requests, levels GROUP BY event_id")
def nearest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("event_id", A.nearest_level(c("k") % 11 + 4 + lit(0.5), sorted(ZOOMS)).alias("level"))


@query("""WITH r AS (SELECT l_suppkey AS g, (l_orderkey * 37 + l_linenumber * 11) % 20000 AS "off", (l_quantity::BIGINT * 3) AS len FROM lineitem),
m AS (SELECT *, max("off" + len) OVER (PARTITION BY g ORDER BY "off", len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR "off" > seen + 64 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY "off", len ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT g, min("off") AS first, max("off" + len) - min("off") AS size FROM n GROUP BY g, run""")
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("g"), ((c("l_orderkey") * 37 + c("l_linenumber") * 11) % 20000).alias("off"), (c("l_quantity").cast("bigint") * 3).alias("len"))
    return S.coalesce_ranges(r, "g", "off", "len", 64)


@query(f"WITH {REQUESTS_SQL} SELECT event_id, coalesce(k // 10 IS DISTINCT FROM lag(k // 10) OVER w OR row_number() OVER w = 1, true) AS builds FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def view_change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).withColumn("view", F.floor(c("k") / 10))
    return S.changed(r, "user_id", ["ts", "event_id"], ["view"]).select("event_id", "builds")


@query(f"""WITH {REQUESTS_SQL}, cam AS (SELECT event_id, 15473550.0 + k * 100 AS x, 4163880.0 - k * 50 AS y, 4 + k % 11 AS zoom FROM requests),
h AS (SELECT *, 400 * (2 * pi() * 6378137.0 / ((1 << zoom) * 512)) AS hx, 300 * (2 * pi() * 6378137.0 / ((1 << zoom) * 512)) AS hy FROM cam),
b AS (SELECT event_id, least(greatest(floor((x - hx + pi() * 6378137.0) / (2 * pi() * 6378137.0) * 4096), 0), 4095)::INT AS min_tx, least(greatest(floor((x + hx + pi() * 6378137.0) / (2 * pi() * 6378137.0) * 4096), 0), 4095)::INT AS max_tx,
 least(greatest(floor((pi() * 6378137.0 - y - hy) / (2 * pi() * 6378137.0) * 4096), 0), 4095)::INT AS min_ty, least(greatest(floor((pi() * 6378137.0 - y + hy) / (2 * pi() * 6378137.0) * 4096), 0), 4095)::INT AS max_ty FROM h)
SELECT *, (max_tx - min_tx + 1)::BIGINT * (max_ty - min_ty + 1) AS tiles FROM b""")
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select("event_id", (c("k") * 100 + lit(15473550.0)).alias("x"), (lit(4163880.0) - c("k") * 50).alias("y"), (c("k") % 11 + 4).alias("zoom"))
    box = M.visible_range(c("x"), c("y"), c("zoom").cast("double"), lit(0.0), lit(800), lit(600), lit(12))
    r = r.select("event_id", *(v.alias(k) for k, v in box.items()))
    return r.withColumn("tiles", (c("max_tx") - c("min_tx") + 1).cast("bigint") * (c("max_ty") - c("min_ty") + 1))


@query(f"WITH {WAYS_SQL}, w AS (SELECT id, custkey, kind, CASE status WHEN 'O' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS layer, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 ELSE 3 END AS draw FROM ways) SELECT custkey, id, row_number() OVER (PARTITION BY custkey ORDER BY layer, draw, kind, id)::INT AS rank FROM w")
def painter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ways(spark, sf_dir).select("id", "custkey", C.classify_way(c("tags"))["kind"].alias("kind"), C.way_layer(c("tags")).alias("layer"))
    dim = kind_dimension(spark).where("shape = 'road'").select(c("ordinal").alias("kind"), c("rank").alias("draw"))
    return N.painter_order(w.join(F.broadcast(dim), "kind"), ["custkey"], ["layer", "draw", "kind", "id"]).select("custkey", "id", "rank")


@query(f"WITH {TILES_SQL} SELECT '{{\"format\":\"tiles\",\"zoom_levels\":[' || string_agg(z, ',' ORDER BY z) || ']}}' AS metadata, count(*) AS n FROM (SELECT DISTINCT z FROM tiles)")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tiles(spark, sf_dir).agg(F.array_sort(F.collect_set("z")).alias("zoom_levels"))
    text = F.to_json(F.struct(lit("tiles").alias("format"), "zoom_levels"))
    return z.select(text.alias("metadata"), F.size(F.from_json(text, "format STRING, zoom_levels ARRAY<INT>")["zoom_levels"]).cast("bigint").alias("n"))


@query("""WITH b AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 100003 * 20)::DOUBLE AS min_x, (o_custkey * 104729 % 10007 * 20)::DOUBLE AS min_y, 100 + o_orderkey % 1000 AS w, 50 + o_custkey % 700 AS h FROM orders)
SELECT l.id AS a, r.id AS b FROM b l JOIN b r ON l.id < r.id AND l.min_x <= r.min_x + r.w + 150 AND r.min_x <= l.min_x + l.w + 150 AND l.min_y <= r.min_y + r.h + 150 AND r.min_y <= l.min_y + l.h + 150""")
def parallel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all orders, spread over a large area, that lie within 150 m of one another."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") * 7919 % 100003 * 20).cast("double").alias("min_x"), (c("o_custkey") * 104729 % 10007 * 20).cast("double").alias("min_y"), "o_custkey")
    return N.near_boxes(o.select("id", "min_x", "min_y", (c("min_x") + 100 + c("id") % 1000).alias("max_x"), (c("min_y") + 50 + c("o_custkey") % 700).alias("max_y")), 150.0, 500.0)


@query(f"WITH {_MORTON_SQL}, l AS (SELECT z, tx, ty, m, m >> (2 * (z - 2)) AS bucket, ((1::BIGINT << (2 * (z - 2))) - 1) // 3 + m % (1::BIGINT << (2 * (z - 2))) AS local_id FROM m WHERE z >= 2) SELECT z, tx, ty, bucket, local_id, tx AS back_x, ty AS back_y, z AS back_z FROM l")
def bucket_local_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = distinct_tiles(spark, sf_dir).where("z >= 2").withColumn("bucket", I.bucket(I.morton(c("tx"), c("ty")), c("z"), 2)).withColumn("local_id", I.bucket_local_id(c("tx"), c("ty"), c("z"), 2))
    x, y, z = I.of_bucket_local(c("local_id"), c("bucket"), 2)
    return t.select("z", "tx", "ty", "bucket", "local_id", x.alias("back_x"), y.alias("back_y"), z.alias("back_z"))


@query("SELECT o_orderkey AS id, round((CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 4 ELSE 2 END END) * 3.7::DOUBLE, 6) AS width FROM orders")
def road_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths by lanes, or where none are told by the kind's own."""
    dim = kind_dimension(spark).where("shape = 'road'").select(c("ordinal").alias("kind"), "default_lanes")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 4).alias("lanes"), C.classify_way(way_tags(c("o_orderpriority"), c("o_orderstatus")))["kind"].alias("kind"))
    return o.join(F.broadcast(dim), "kind").select("id", F.round(kinds.road_width(c("lanes"), c("default_lanes")), 6).alias("width"))


@query(f"WITH {WAYS_SQL} SELECT 'road' AS shape, kind, count(*) AS n FROM ways GROUP BY kind UNION ALL SELECT 'label', s_nationkey % 8, count(*) FROM supplier WHERE s_nationkey % 8 < 6 GROUP BY ALL UNION ALL SELECT 'area', 3, count(*) FROM part HAVING count(*) > 0")
def shape_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = ways(spark, sf_dir).select(C.classify_way(c("tags")).alias("s")).select("s.shape", "s.kind")
    labels = classify_place(spark, sf_dir).select(lit("label").alias("shape"), c("place").alias("kind"))
    areas = table(spark, sf_dir, "part").select(lit("area").alias("shape"), lit(3).alias("kind"))
    return roads.unionByName(labels).unionByName(areas).groupBy("shape", "kind").agg(F.count("*").alias("n"))
