"""Column builders: known values."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry as G
from quadrille.functions import kinds, tags, tileid
from quadrille.functions import mercator as M
from quadrille.operators import archive, sequences
from quadrille.operators.graph import components

PAIRS = "ARRAY<STRUCT<k: STRING, v: STRING>>"


def one(spark, column, kv):
    df = spark.createDataFrame([([tuple(x) for x in kv],)], f"tags {PAIRS}")
    return df.select(column(F.col("tags")).alias("c")).first().c


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("lanes=3,oneway=yes", (3, 0)), ("oneway=yes", (1, 0)), ("lanes=2,oneway=-1", (0, 2)), ("lanes=4", (2, 2)), ("lanes=3", (2, 1)), ("", (1, 1)),
        ("lanes=5,lanes:forward=3,lanes:backward=2", (3, 2)), ("lanes=5,lanes:forward=3", (3, 2)), ("lanes:forward=2", (2, 2)), ("lanes:backward=3", (3, 3)), ("lanes=x", (1, 1)), ("lanes=999", (1, 1)), ("lanes=2,lanes=6", (3, 3)), ("lanes:forward=0,oneway=yes", (1, 0)),
    ],
)
def test_lanes(spark, text, want):
    assert tuple(one(spark, tags.lanes_of, [p.split("=") for p in text.split(",") if p])) == want


@pytest.mark.parametrize(("value", "want"), [(None, 1), ("5", 5), ("2.5", 3), ("0", 1), ("garbage", 1), ("999", 255), ("NaN", 1)])
def test_floors(spark, value, want):
    assert one(spark, tags.floors_of, [("building:levels", value)] if value else []) == want


def test_classes(spark):
    way = lambda *kv: one(spark, tags.classify_way, kv)
    assert tuple(way(("highway", "motorway_link"))) == ("road", 16) and tuple(way(("highway", "tertiary_link"))) == ("road", 20) and tuple(way(("highway", "motorway"))) == ("road", 0)
    assert tuple(way(("highway", "steps"), ("railway", "narrow_gauge"))) == ("road", 14) and way(("highway", "footway")) is None
    assert tuple(way(("building", "no"), ("highway", "primary"))) == ("area", 3) and tuple(way(("landuse", "meadow"))) == ("area", 2)
    assert one(spark, tags.classify_relation, [("type", "multipolygon"), ("natural", "water")]) == 0 and one(spark, tags.classify_place, [("place", "x"), ("place", "city")]) is None
    assert one(spark, tags.structure_of, [("tunnel", "yes"), ("bridge", "no")]) == 2 and one(spark, tags.structure_of, [("tunnel", "yes"), ("bridge", "viaduct")]) == 1
    assert one(spark, tags.way_layer, [("layer", "0"), ("bridge", "yes")]) == 1 and one(spark, tags.way_layer, [("layer", " -2 ")]) == -2 and one(spark, tags.layer_of, [("layer", "300")]) == 0
    assert one(spark, tags.name_of, [("name", ""), ("name", "B")]) == "B" and one(spark, tags.classify_poi, [("highway", "traffic_signals")]) == 0
    assert one(spark, lambda t: tags.matches(t, tags.WAY_FILTER), [("building", "x")]) and not one(spark, lambda t: tags.matches(t, tags.WAY_FILTER), [("leisure", "pitch")])
    assert one(spark, lambda t: tags.matches(t, tags.RELATION_FILTER), [("type", "multipolygon")])  # any clause is enough
    dim = kinds.kind_dimension(spark)
    assert dim.count() == 35 and dim.where("is_link").count() == 5


def test_tile_numbers(spark):
    rng = random.Random(2)
    rows = [(0, 0, 4), (1, 0, 4), (0, 1, 4), (1, 1, 4), (2, 0, 4), (3, 3, 4), (12345, 6789, 14), (16383, 16383, 14)] + [(rng.randrange(1 << z), rng.randrange(1 << z), z) for z in range(15)]
    df = spark.createDataFrame(rows, "x INT, y INT, z INT")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    m = tileid.morton(x, y)
    got = df.select("x", "y", "z", m.alias("m"), tileid.morton_x(m).alias("mx"), tileid.morton_y(m).alias("my"), tileid.build_id(x, y, z).alias("b"), tileid.archive_id(x, y, z).alias("a"), tileid.zoom_of_id(tileid.build_id(x, y, z)).alias("zz"), tileid.bucket(m, z, 6).alias("bucket")).collect()
    assert [r.m for r in got[:6]] == [0, 1, 2, 3, 4, 15]
    for r in got:
        assert (r.mx, r.my, r.zz) == (r.x, r.y, r.z) and r.a == tileid.archive_id_int(r.z, r.x, r.y) and r.bucket < 4**6
        if r.z >= 6:
            assert r.bucket == sum(((r.x >> (r.z - 6) + k & 1) << 2 * k) + ((r.y >> (r.z - 6) + k & 1) << 2 * k + 1) for k in range(6))


def test_codes(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, 8192, -8192)], "d INT")
    assert [tuple(r) for r in df.select(tileid.zigzag16(F.col("d")), tileid.unzigzag16(tileid.zigzag16(F.col("d")))).collect()] == [(0, 0), (1, -1), (2, 1), (16384, 8192), (16383, -8192)]
    sizes = spark.createDataFrame([(0,), (127,), (128,), (300,), (2**62,)], "v BIGINT").select(tileid.varint_size(F.col("v"))).collect()
    assert [r[0] for r in sizes] == [1, 1, 2, 2, 9]


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 4), (4, 0), (0, 0), (0, 4))))
    r = spark.range(1).select(G.ring_area(ring).alias("a"), G.point_in_ring(F.lit(1.0), F.lit(1.0), ring).alias("i"), G.point_in_ring(F.lit(5.0), F.lit(1.0), ring).alias("o"), G.canonical_ring(ring).alias("c"), F.size(G.close_ring(ring)).alias("n"), G.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("d"), G.to_scene(F.lit(5), F.lit(2), F.lit(14), F.lit(12), 8192).alias("s"), M.nanodegrees(F.lit(1_390_000_000), 100, 0).alias("deg")).first()
    assert (r.a, r.i, r.o, r.n, r.d) == (16.0, True, False, 5, 4.0) and tuple(r.c[0]) == (0.0, 0.0) and r.s == (2 * 8192 + 5) << 2 and abs(r.deg - 139) < 1e-9
    assert M.simplify_tolerance(4.0, 8192, 360) > 91 and M.simplify_tolerance(0.01, 8192, 360) == 1.0


def test_sequences(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 100, 50), (1, 170, 30), (1, 100000, 10)], "g INT, off BIGINT, len BIGINT")
    assert sorted((r["first"], r["size"]) for r in sequences.coalesce_ranges(df, "g", "off", "len", 64).collect()) == [(0, 200), (100000, 10)]
    ids = [0, 1, 63, 64, 65, 127, 128, 500, 511, 512, 1000, 70000]
    ranks = {r.id: r.rank for r in sequences.dense_ids(spark.createDataFrame([(i,) for i in ids + ids[:3]], "id BIGINT"), "id", "rank").collect()}
    assert ranks == {i: k for k, i in enumerate(ids)}
    tiles = spark.createDataFrame([(k, 7 if k < 20 else k % 2) for k in range(5, 40)], "tile_id BIGINT, o BIGINT")
    assert sorted((r["first"], r.n) for r in sequences.runs(tiles, "o", "tile_id", block=4).collect()) == [(5, 15)] + [(k, 1) for k in range(20, 40)]
    e = spark.createDataFrame([(10, 0, 5, 3), (300, 5, 5, 1000)], "tile_id BIGINT, offset BIGINT, length BIGINT, run_length BIGINT")
    got = {r.q: r.tile_id for r in archive.find(spark.createDataFrame([(q,) for q in (9, 11, 13, 1299, 1300)], "q BIGINT"), e).collect()}
    assert got == {9: None, 11: 10, 13: None, 1299: 300, 1300: None}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(50)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {n: label.get(n, n) for n in want} == want
