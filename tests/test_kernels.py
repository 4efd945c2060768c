"""Geometry and codec kernels: known cases and invariants."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.functions.tileid import archive_id_int
from quadrille.kernels import areas, lines, pmtiles, tilecodec, varint

RECT = (0.0, 0.0, 100.0, 100.0)


def test_varint_edges():
    for v in (0, 1, 127, 128, 300, 2**32 - 1, 2**64 - 1):
        assert varint.read_uvarint(varint.write_uvarint(v)) == (v, len(varint.write_uvarint(v)))
    assert varint.read_uvarint(b"\x80") is None and varint.read_uvarint(b"\xff" * 11) is None
    with pytest.raises(ValueError):
        varint.read_all(b"\x80")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(-(2**62), 2**62)), st.lists(st.booleans()))
def test_codes_round_trip(values, signed, flags):
    assert varint.read_all(varint.write_all(values)).tolist() == values
    assert varint.unzigzag(varint.zigzag(np.array(signed, np.int64))).tolist() == signed
    assert varint.unpack_bits(varint.pack_bits(flags), len(flags)) == flags


def test_directory_and_lookup():
    e = [pmtiles.Entry(0, 0, 10, 1), pmtiles.Entry(1, 10, 20, 3), pmtiles.Entry(4, 10, 20, 1), pmtiles.Entry(5, 30, 5, 1)]
    assert pmtiles.read_directory(pmtiles.write_directory(e)) == e
    e = [pmtiles.Entry(10, 0, 5, 3), pmtiles.Entry(100, 0, 40, 0)]
    assert pmtiles.find(e, 9) is None and pmtiles.find(e, 11) == e[0] and pmtiles.find(e, 13) is None and pmtiles.find(e, 500) == e[1]


def test_header_metadata_and_coalescing():
    h = pmtiles.Header((127, 5), (1, 2), (3, 4), (5, 6), 7, 8, 9, 1, 1, 1, 0, (3, 14), (-1, -2, 3, 4), 5, (6, 7))
    assert len(h.to_bytes()) == pmtiles.HEADER_SIZE and pmtiles.Header.parse(h.to_bytes()) == h
    with pytest.raises(ValueError):
        pmtiles.Header.parse(b"x" * 127)
    assert pmtiles.read_zooms(pmtiles.write_metadata([14, 3, 6])) == [3, 6, 14] and pmtiles.read_zooms(b'{"format":"other"}') is None and pmtiles.read_zooms(pmtiles.write_metadata([])) is None
    assert pmtiles.coalesce([(0, 100), (100, 50), (170, 30), (100000, 10)], 64) == [(0, 200), (100000, 10)]
    assert pmtiles.coalesce([(0, 10), (100, 10)], 64) == [(0, 10), (100, 10)]
    assert pmtiles.coalesce([(0, 100), (10, 20)], 0) == [(0, 100)] and pmtiles.coalesce([(0, 50), (50, 50), (101, 10)], 0) == [(0, 100), (101, 10)]


def test_root_stays_small():
    entries = [pmtiles.Entry(3 * k, 100 * k, 100, 1) for k in range(60_000)]
    root, leaves = pmtiles.directories(entries)
    assert len(root) <= pmtiles.ROOT_MOST and leaves
    e = pmtiles.find(pmtiles.read_directory(root), 3 * 41_000)
    assert pmtiles.find(pmtiles.read_directory(leaves[e.offset : e.offset + e.length]), 3 * 41_000) == entries[41_000]


def test_archive_ids():
    assert archive_id_int(0, 0, 0) == 0 and sorted(archive_id_int(1, x, y) for x in (0, 1) for y in (0, 1)) == [1, 2, 3, 4]
    ids = {archive_id_int(5, x, y): (x, y) for x in range(32) for y in range(32)}
    walk = [ids[k] for k in sorted(ids)]
    assert len(walk) == 1024 and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(walk, walk[1:]))


RECORDS = [
    {"shape": "road", "kind": 2, "start": 1, "end": 2, "structure": 1, "layer": -1, "lanes_fwd": 2, "lanes_bwd": 1, "name": "Straße 東", "coords": [(0, 0), (8192, 5), (3, 8192)]},
    {"shape": "road", "kind": 0, "start": 0, "end": 0, "structure": 0, "layer": 0, "lanes_fwd": 1, "lanes_bwd": 1, "name": None, "coords": [(9, 9), (1, 1)]},
    {"shape": "area", "kind": 0, "layer": -1, "floors": 0, "rings": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 4), (4, 4)]], "clip": [[True, False, False, True], [False, False, False]]},
    {"shape": "label", "class": 3, "anchor": (5, 6), "name": "Straße 東"},
    {"shape": "poi", "kind": 0, "anchor": (7, 8192)},
]


def test_tile_round_trip():
    data = tilecodec.encode(RECORDS)
    assert tilecodec.decode(data) == RECORDS and tilecodec.decode(tilecodec.encode([])) == []
    for bad in (b"", data[:-3], b"\x00" * 30):
        with pytest.raises(ValueError):
            tilecodec.decode(bad)


def test_simplify():
    line = [(0, 0), (1, 0), (2, 0)]
    assert len(lines.simplify_pinned(line, [False] * 3, 1.0)) == 2
    assert len(lines.simplify_pinned(line, [False, True, False], 1.0)) == 3
    assert len(lines.simplify_pinned(line, [], 1.0)) == 2
    assert lines.simplify_vw([(0, 0), (5, 9), (10, 0)], 1.0) == [(0, 0), (5, 9), (10, 0)]


def test_clip_line():
    assert lines.clip_line([(1, 1), (5, 5)], RECT) == [([(1, 1), (5, 5)], False, False)]
    assert lines.clip_line([(-50, 50), (150, 50)], RECT) == [([(0, 50), (100, 50)], True, True)]
    assert lines.clip_line([(-50, -50), (-1, -1)], RECT) == []
    got = lines.clip_line([(50, 50), (150, 50), (150, 60), (50, 60)], RECT)
    assert [g[1:] for g in got] == [(False, True), (True, False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 150), st.integers(-50, 150)), min_size=2, max_size=8))
def test_clipped_length(points):
    inside = sum(math.dist(a, b) * (t[1] - t[0]) for a, b in zip(points, points[1:]) if (t := lines.clip_segment(a, b, RECT)))
    assert abs(sum(math.dist(a, b) for piece, _, _ in lines.clip_line(points, RECT) for a, b in zip(piece, piece[1:])) - inside) < 1e-6


def test_strokes_and_parallels():
    strokes = lines.chain_strokes([[(0, 0), (10, 0)], [(20, 1), (10, 0)], [(10, 0), (10, 10)], [(30, 0), (20, 1)]])
    assert sorted(map(len, strokes)) == [2, 4]
    a = [(k * 100.0, 0.0) for k in range(20)]
    assert lines.drop_parallel([a[:10], [(x, 60.0) for x, _ in a], [(x, 2000.0) for x, _ in a]]) == [1, 2]


DISCONNECTED, CONNECTED, CUT = 0, 1, 2


def road(coords, start=DISCONNECTED, end=DISCONNECTED, lanes=(1, 1), layer=0):
    return {"coords": coords, "start": start, "end": end, "lanes": [lanes] * len(coords), "layer": layer, "name": None, "structure": 0}


def test_weld_across_a_tile_edge():
    (r,) = lines.weld([road([(4000, 50), (8192, 50)], DISCONNECTED, CUT), road([(8192, 50), (12000, 50)], CUT, DISCONNECTED)], 8)
    assert r["coords"] == [(4000, 50), (8192, 50), (12000, 50)] and (r["start"], r["end"]) == (DISCONNECTED, DISCONNECTED)
    (r,) = lines.weld([road([(0, 50), (8192, 50)], DISCONNECTED, CUT)], 8)
    assert r["end"] == CUT


def test_weld_keeps_lanes_by_vertex():
    (r,) = lines.weld([road([(0, 0), (100, 0)], 0, 1, (2, 0)), road([(100, 0), (200, 0)], 1, 0, (3, 0))], 8)
    assert r["coords"] == [(0, 0), (100, 0), (200, 0)] and [f + b for f, b in r["lanes"]] == [2, 2, 3]
    (r,) = lines.weld([road([(0, 0), (100, 0)], 0, 1, (2, 1)), road([(200, 0), (100, 0)], 0, 1, (1, 2))], 8)
    assert r["lanes"] == [(2, 1)] * 3 and r["coords"] == [(0, 0), (100, 0), (200, 0)]


def test_weld_at_junctions_and_crossings():
    through = lines.weld([road([(0, 0), (100, 0)], 0, 1), road([(100, 0), (200, 0)], 1, 0), road([(100, 0), (100, 100)], 1, 0)], 8)
    assert sorted(len(r["coords"]) for r in through) == [2, 3] and [r["coords"] for r in through if len(r["coords"]) == 3] == [[(0, 0), (100, 0), (200, 0)]]
    cross = lines.weld([road([(-100, 0), (0, 0)], 0, 1), road([(0, 0), (100, 0)], 1, 0), road([(0, -100), (0, 0)], 0, 1), road([(0, 0), (0, 100)], 1, 0)], 8)
    assert [len(r["coords"]) for r in cross] == [3, 3]


def test_weld_over_gaps_turns_and_layers():
    (r,) = lines.weld([road([(0, 0), (100, 0)], 0, 1), road([(105, 0), (200, 0)], 1, 0)], 8)
    assert r["coords"] == [(0, 0), (100, 0), (105, 0), (200, 0)]
    assert len(lines.weld([road([(0, 0), (100, 0)], 0, 1), road([(100, 40), (200, 40)], 1, 0)], 8)) == 2
    assert len(lines.weld([road([(0, 0), (100, 0)]), road([(100, 0), (0, 5)])], 8)) == 1  # two ends join at any angle
    assert lines.weld([road([(0, 0), (10, 0)], layer=1), road([(10, 0), (20, 0), (30, 0)], layer=0)], 8)[0]["layer"] == 0
    assert lines.weld([road([(0, 0), (10, 0)], layer=1), road([(10, 0), (20, 0)], layer=0)], 8)[0]["layer"] == 1
    square = [road([(0, 0), (100, 0)]), road([(100, 100), (100, 0)]), road([(100, 100), (0, 100)]), road([(0, 0), (0, 100)])]
    (r,) = lines.weld(square, 8)
    assert r["coords"] == [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    assert lines.weld([], 8) == [] and len(lines.weld([road([(0, 0)]), road([(0, 0), (9, 9)])], 8)) == 2


def test_strokes_do_not_depend_on_the_order_of_lines():
    rng = random.Random(2)
    grid = [[(x * 10.0, y * 10.0), ((x + dx) * 10.0, (y + 1 - dx) * 10.0)] for x in range(5) for y in range(5) for dx in (0, 1)]
    want = None
    for _ in range(5):
        rng.shuffle(grid)
        found = sorted(tuple(min(s, s[::-1])) for s in lines.chain_strokes([line[:: rng.choice((1, -1))] for line in grid]))
        assert want in (None, found)
        want = found
    assert {len(s) for s in want} == {6} and len(want) == 10  # straight through every crossing


def test_rings_and_holes():
    assert areas.assemble_rings([[1, 2, 3], [5, 4, 3], [5, 1], [7, 8, 9, 7], [9]]) == [[1, 2, 3, 4, 5, 1], [7, 8, 9, 7]]
    assert areas.assemble_rings([[1, 2], [2, 3]]) == [] and areas.assemble_rings([[1, 2], [2, 1]]) == [] and areas.assemble_rings([]) == []
    eight = areas.assemble_rings([[1, 2, 3], [5, 6, 1], [3, 1], [1, 4, 5]])
    assert sorted(sorted(set(r)) for r in eight) == [[1, 2, 3], [1, 4, 5, 6]] and all(r[0] == r[-1] for r in eight)
    a, b = [(0, 0), (10, 0), (10, 10), (0, 10)], [(20, 0), (30, 0), (30, 10), (20, 10)]
    hole, far = [(22, 2), (24, 2), (24, 4)], [(50, 50), (51, 50), (51, 51)]
    assert areas.assign_holes([a, b], [hole, far]) == [[a], [b, hole]] and areas.assign_holes([a], [far]) == [[a, far]]


def star(rng, n, cx, cy, r):
    turns = [2 * math.pi * (k + rng.random() * 0.9) / n for k in range(n)]  # gaps under half a turn: a simple polygon
    return [(cx + math.cos(t) * r * u, cy + math.sin(t) * r * u) for t in turns for u in [rng.uniform(0.3, 1)]]


def size(polygons):
    return sum(abs(areas.area(p[0])) - sum(abs(areas.area(h)) for h in p[1:]) for p in polygons)


def test_tiles_share_a_polygon_without_loss():
    rng = random.Random(4)
    for _ in range(150):
        outer = star(rng, rng.randint(5, 14), 3, 3, 2.9)
        rings = [outer]
        hole = star(rng, 5, 3, 3, 0.25)
        if abs(areas.area(outer)) > 4 and all(areas.inside(p, outer) for p in hole):
            rings.append(hole)
        total = abs(areas.area(outer)) - sum(abs(areas.area(h)) for h in rings[1:])
        parts = [p for x in range(-1, 7) for y in range(-1, 7) for p in areas.clip_polygon(rings, (x, y, x + 1, y + 1))]
        assert abs(size(parts) - total) < 1e-6
        cells = areas.tile_polygon(rings, 8192)
        assert abs(size([r for _, r, _ in cells]) / 8192**2 - total) < 0.02


def test_clip_to_tiles():
    got = areas.tile_polygon([[(0.2, 0.2), (1.8, 0.2), (1.8, 1.8), (0.2, 1.8)]], 4096)
    assert sorted(t for t, _, _ in got) == [(0, 0), (0, 1), (1, 0), (1, 1)] and all(len(f[0]) == len(r[0]) for _, r, f in got)
    ring = [(-10, -10), (110, -10), (110, 110), (-10, 110)]
    assert areas.clip_polygon([ring], RECT) == [[[(0, 0), (100, 0), (100, 100), (0, 100)]]] or size(areas.clip_polygon([ring], RECT)) == 10_000
    assert areas.clip_polygon([ring, ring[::-1]], RECT) == [] and areas.clip_polygon([[(200, 200), (210, 200), (205, 210)]], RECT) == []


def test_union_area():
    rng = random.Random(8)
    square = lambda x, y, s=1.0: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    assert abs(size(areas.union([square(0, 0), square(0.5, 0.5)])) - 1.75) < 1e-9
    assert len(areas.union([square(0, 0), square(1, 0)])) == 1 and len(areas.union([square(0, 0), square(3, 0)])) == 2
    ring = areas.union([square(0, 0, 3) + square(1, 1)])
    assert len(ring) == 1 and len(ring[0]) == 2 and abs(size(ring) - 8) < 1e-9
    for _ in range(20):
        shapes = [[star(rng, 6, rng.random() * 4, rng.random() * 4, 1.5)] for _ in range(4)]
        out = areas.union(shapes)
        hits = [(x, y) for _ in range(2000) for x, y in [(rng.uniform(-2, 6), rng.uniform(-2, 6))]]
        near = sum(any(areas.inside(p, s[0]) for s in shapes) != any(areas.inside(p, o[0]) and not any(areas.inside(p, h) for h in o[1:]) for o in out) for p in hits)
        assert near == 0


def test_rasters():
    assert areas.fill_spans([(0, 0), (4, 0), (4, 2), (0, 2)]) == [(0, 0, 3), (1, 0, 3)]
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:4] = mask[2:7, 5:7] = True
    assert areas.close_mask(mask, 1)[2:7, 4].all() and (areas.close_mask(mask, 0) == mask).all()
    (outline,) = areas.contours(areas.close_mask(mask, 1))
    assert 20 < areas.area(outline) < 25
    hollow = np.ones((5, 5), bool)
    hollow[2, 2] = False
    assert len(areas.contours(hollow)) == 1
    x, y = areas.interior_point([[(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (9, 1), (9, 9), (1, 9)]])
    assert areas.inside((x, y), [(0, 0), (10, 0), (10, 10), (0, 10)]) and not areas.inside((x, y), [(1, 1), (9, 1), (9, 9), (1, 9)])
