"""The whole way: a small extract to an archive, and the archive to a scene."""

import math

import numpy as np
import pytest

from quadrille.functions import mercator
from quadrille.kernels import areas, tilecodec
from quadrille.operators import shapes
from quadrille.plans import build, view
from quadrille.sources import osmpbf, shapefile
from quadrille.sources.pmtiles import Archive


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("build")
    at = lambda k: (139.0 + (k % 20) * 0.002, 35.0 + (k // 20) * 0.002)
    nodes = [(k, *at(k), [("place", "city"), ("name", "Middle")] if k == 150 else [("highway", "traffic_signals")] if k == 151 else []) for k in range(1, 300)]
    ways = [(1, list(range(20, 40)), [("highway", "motorway"), ("name", "Main"), ("lanes", "5")]), (2, [30, 50, 70, 90], [("highway", "primary"), ("bridge", "yes")]), (3, list(range(40, 60)), [("highway", "residential")])]
    ways += [(10, [100, 110, 170, 160, 100], [("natural", "wood"), ("name", "Wood")]), (11, [200, 210], []), (12, [210, 270, 260, 200], []), (13, [222, 224, 244, 242, 222], []), (14, [1, 2, 22, 21, 1], [("building", "yes"), ("building:levels", "3")])]
    relations = [(1, [("type", "multipolygon"), ("natural", "water"), ("name", "Lake")], [(11, "way", "outer"), (12, "way", ""), (13, "way", "inner")]), (2, [("type", "route"), ("route", "road")], [(1, "way", ""), (3, "way", "")])]
    osmpbf.write_pbf(str(d / "x.pbf"), nodes, ways, relations)
    x0 = math.radians(139.0) * 6378137
    shapefile.write_shp(str(d / "w.shp"), [[[(x0, 4100000.0), (x0, 4200000.0), (x0 + 500.0, 4200000.0), (x0 + 500.0, 4100000.0), (x0, 4100000.0)]]])
    header = build.build(spark, str(d / "x.pbf"), str(d / "x.pmtiles"), build.TileBuildConfig(clip_water_to_extract_bbox=True), str(d / "w.shp"))
    return str(d / "x.pmtiles"), header


def contents(path, z):
    a = Archive(path)
    return [r for e in a.entries() for k in range(e.run_length) for t in [__import__("quadrille.sources.pmtiles", fromlist=["x"]).tile_of(e.tile_id + k)] if t[0] == z for r in tilecodec.decode(a.tile(*t))]


def test_archive_holds_every_kind(made):
    path, header = made
    assert header.addressed > 4 and header.zooms == (4, 14)
    base = contents(path, 14)
    roads = {r["kind"] for r in base if r["shape"] == "road"}
    areas = {r["kind"] for r in base if r["shape"] == "area"}
    assert roads == {0, 2, 6} and areas == {0, 1, 3}
    assert {(r["class"], r["name"]) for r in base if r["shape"] == "label"} == {(0, "Middle"), (6, "Lake"), (7, "Wood")} and any(r["shape"] == "poi" for r in base)
    main = [r for r in base if r["shape"] == "road" and r["kind"] == 0]
    assert {(r["lanes_fwd"], r["lanes_bwd"], r["name"]) for r in main} == {(3, 2, "Main")} and {r["start"] for r in main} <= {0, 1, 2}
    assert all(r["structure"] == 1 and r["layer"] == 1 for r in base if r["shape"] == "road" and r["kind"] == 2)
    assert any(len(r["rings"]) == 2 for r in base if r["shape"] == "area" and r["kind"] == 0)
    assert any(r["layer"] == -1 for r in base if r["shape"] == "area" and r["kind"] == 0)
    coarse = contents(path, 8)
    assert {r["kind"] for r in coarse if r["shape"] == "road"} == {12} and not any(r["shape"] == "area" and r["kind"] == 3 for r in coarse)


def test_scene(spark, made):
    path, _ = made
    scene = view.scene(spark, path, view.Camera(139.02, 35.01, 13.0, 0.0, (1200, 900)))
    roads = scene["roads"].collect()
    assert {r.kind for r in roads} == {0, 2} or {r.kind for r in roads} >= {0, 2}
    assert sum(1 for r in roads if r.kind == 0) < sum(1 for r in contents(path, 14) if r["shape"] == "road" and r["kind"] == 0)  # pieces are welded
    assert scene["areas"].count() and scene["labels"].where("name = 'Middle'").count() == 1
    ranks = [r["rank"] for r in scene["areas"].orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    assert view.scene(spark, path, view.Camera(0.0, 0.0, 13.0, 0.0, (256, 256)))["roads"].count() == 0


def test_scene_beyond_the_last_level_shows_ancestors(spark, made):
    path, _ = made
    camera = view.Camera(139.02, 35.01, 15.0, 0.0, (600, 400))
    base, beyond = (view.scene(spark, path, camera, level=z) for z in (14, 16))
    assert beyond["roads"].count() and {(r.kind, r.name) for r in beyond["roads"].collect()} <= {(r.kind, r.name) for r in base["roads"].collect()}
    assert all(r.width_start > 0 for r in base["roads"].collect())
    archive = Archive(path)
    wanted = view.visible(camera, 16)
    found = view.tiles_or_ancestors(archive, wanted)
    assert {t[0] for t in found} == {14} and set(found) <= {(14, x >> 2, y >> 2) for _, x, y in wanted}
    assert view.tiles_or_ancestors(archive, [(12, 0, 0)]) == {}


def test_pan_and_zoom():
    c = view.Camera(139.0, 35.0, 13.0, 0.0, (800, 600))
    assert view.zoomed(c, 99).zoom == 20 and view.zoomed(c, -99).zoom == 3
    moved = view.panned(c, 100, 0)
    assert moved.lon < c.lon and abs(moved.lat - c.lat) < 1e-9
    x, y = view.to_screen(c, *view.metres(c))
    assert abs(x - 400) < 1e-6 and abs(y - 300) < 1e-6


def test_groups_across_block_borders_are_culled_as_wholes(spark):
    rng = np.random.default_rng(4)
    mask = np.zeros((48, 48), bool)
    for _ in range(45):
        y, x = rng.integers(44, size=2)
        h, w = rng.integers(1, 5, size=2)
        mask[y : y + h, x : x + w] = True
    mask[14:18, 14:18] = True  # 4 pixels in each of four blocks
    pixels = spark.createDataFrame([(int(x), int(y)) for y, x in np.argwhere(mask)], "px INT, py INT")
    for radius in (0, 2):
        room = np.pad(mask, 32)  # a closing has room on all sides
        closed = areas.close_mask(room, radius)[32:-32, 32:-32]
        got = shapes.outlines(pixels, 1.0, least_px=12.0, radius=radius, block=16).collect()
        inside = np.zeros_like(mask)
        for r in got:
            for y, a, b in areas.fill_spans([(round(p.x + mercator.HALF, 3), round(mercator.HALF - p.y, 3)) for p in r.rings[0]]):
                inside[y, a : b + 1] = True
        whole = np.zeros_like(mask)
        for ring in areas.contours(closed):
            if areas.area(ring) >= 12:
                for y, a, b in areas.fill_spans(ring):
                    whole[y, a : b + 1] = True
        wrong = np.argwhere((inside ^ whole) & closed).tolist()
        assert not wrong and (whole & closed).any() and (closed & ~whole).any()
