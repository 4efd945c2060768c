"""Group kernels on Spark: how they are planned and where they end, on a few rows."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from quadrille.functions.mercator import EDGE, HALF
from quadrille.kernels import lines
from quadrille.operators import network, shapes
from quadrille.operators.storage import staged
from quadrille.plans import catalog
from quadrille.plans.projection import POINTS_SQL

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parallels_are_never_broadcast(spark):
    """Lines of a small file have many vertices in many cells, which a driver can't hold."""
    rows = [(k, [(float(x * 400), float(k % 4 * 60 + k // 4 * 5000)) for x in range(5 + k * 7 % 5)]) for k in range(40)]
    df = spark.createDataFrame(rows, f"id BIGINT, coords ARRAY<{POINT}>")
    stay = shapes.without_parallels(df)
    assert "Broadcast" not in plan(shapes.parallel_edges(staged(df, "lines"), 150.0, 0.6)) and "Broadcast" not in plan(stay)
    assert sorted(r.id for r in stay.select("id").collect()) == lines.drop_parallel([points for _, points in rows])


@pytest.mark.parametrize("name", ["polygon_clip", "tile_shapes_roundtrip"])
def test_squares_beyond_the_grid(spark, tmp_path, name):
    """The 400,900th square touches the grid's upper edge; rows of a larger table go on above it."""
    made = duckdb.sql("SELECT i AS p_partkey FROM (SELECT unnest(range(400890, 400920)) UNION ALL SELECT unnest(range(1199990, 1200000))) t(i)")
    made.write_parquet(str(tmp_path / "part.parquet"))
    sql = entry_module.oracle_sql()[name]
    want = duckdb.sql(sql.replace("FROM part", f"FROM '{tmp_path}/part.parquet'"))
    got = entry_module.queries()[name](spark, str(tmp_path)).select(*(f"`{k}`" for k in want.columns))
    assert min(r.ty for r in got.select("ty").collect()) < 0
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_build_leaves_out_what_lies_beyond_the_grid(spark):
    """Without bounded=False nothing has a tile beyond the edges, and every record has its number."""
    ring = [(20_030_000.0, 20_030_000.0), (20_050_000.0, 20_030_000.0), (20_050_000.0, 20_050_000.0), (20_030_000.0, 20_050_000.0)]
    row = {"id": 1, "kind": 0, "layer": 0, "floors": 0, "lanes_fwd": 0, "lanes_bwd": 0, "structure": 0, "start": 1, "end": 1, "name": None, "rings": [ring], "junctions": [], "aggregated": False}
    df = spark.createDataFrame([{**row, "shape": shape} for shape in ("area", "road")], shapes.SHAPE + ", aggregated BOOLEAN")
    made = {b: shapes.records(df, (14,), extent=8192, simplify_px=0.0, render_px=100_000, agg_max_zoom=0, road_agg_max_zoom=0, bounded=b).select("shape", "tile_id", "tx", "ty").collect() for b in (True, False)}
    on = lambda r: 0 <= r.tx < 1 << 14 and 0 <= r.ty < 1 << 14
    assert {r.shape for r in made[True]} == {"area", "road"} and all(on(r) and r.tile_id is not None for r in made[True])
    assert sorted(r for r in made[False] if on(r)) == sorted(made[True]) and any(r.tile_id is None for r in made[False])


def test_vertices_of_ways_are_those_of_sql_to_the_last_bit(spark, tmp_path):
    """Three parts to an order, on 6,000 latitudes: areas round as SQL's only if no bit differs."""
    duckdb.sql("SELECT i * 200 AS p_partkey FROM range(6000) t(i)").write_parquet(str(tmp_path / "part.parquet"))
    duckdb.sql("SELECT i // 3 AS l_orderkey, (i % 3)::INT AS l_linenumber, i * 200 AS l_partkey, 0::BIGINT AS l_suppkey, 0.0::DOUBLE AS l_extendedprice FROM range(6000) t(i)").write_parquet(str(tmp_path / "lineitem.parquet"))
    duckdb.sql("SELECT i AS o_orderkey, i AS o_custkey, 'O' AS o_orderstatus, '1-URGENT' AS o_orderpriority, DATE '2020-01-01' AS o_orderdate FROM range(2000) t(i)").write_parquet(str(tmp_path / "orders.parquet"))
    points = f"WITH {POINTS_SQL} SELECT x, y FROM points ORDER BY id".replace("FROM part", f"FROM '{tmp_path}/part.parquet'")
    ways = sorted(catalog.way_lines(spark, str(tmp_path)).collect(), key=lambda r: r.way_id)
    assert [(p.x, p.y) for r in ways for p in r.coords] == duckdb.sql(points).fetchall()


def test_segments_are_clipped_once(spark):
    """Pieces as the kernel cuts them; the plan divides as often as it is written, not anew for each value that is named later."""
    ends = [(3.2, 5.1, 6.7, 4.4), (1.5, 1.5, 1.5, 1.5), (2.0, 7.25, 4.5, 7.25), (9.9, 0.1, 8.1, 3.3)]
    metres = lambda x, y: (x * EDGE / 16 - HALF, HALF - y * EDGE / 16)
    segs = spark.createDataFrame([(k, 0, *metres(*e[:2]), *metres(*e[2:])) for k, e in enumerate(ends)], "way_id BIGINT, seg INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE")
    made = network.clip_to_tiles(segs, 4)
    assert made._jdf.queryExecution().optimizedPlan().toString().count(" / ") <= 20
    fraction = lambda x, y: ((x + HALF) / EDGE * 16, (HALF - y) / EDGE * 16)
    for r in made.collect():
        line = [fraction(*metres(*ends[r.way_id][:2])), fraction(*metres(*ends[r.way_id][2:]))]
        [(piece, start, end)] = lines.clip_line(line, (r.tx, r.ty, r.tx + 1, r.ty + 1))
        local = [round((v - t) * 8192) for p in (piece[0], piece[-1]) for v, t in zip(p, (r.tx, r.ty), strict=True)]
        assert (r.cut_start, r.cut_end) == (start, end) and all(abs(a - b) <= 1 for a, b in zip((r.x0, r.y0, r.x1, r.y1), local, strict=True))
    assert {(r.tx, r.ty) for r in made.where("way_id = 0").collect()} == {(3, 5), (3, 4), (4, 4), (5, 4), (6, 4)}
