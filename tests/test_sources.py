"""Data sources: what is written is what is read."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quadrille.functions.tileid import archive_id_int
from quadrille.sources import osmpbf, pmtiles, ranges, register, shapefile


@pytest.fixture(scope="module")
def s(spark):
    register(spark)
    return spark


@pytest.mark.parametrize("dense", [True, False])
def test_pbf(s, tmp_path, dense):
    path = str(tmp_path / "x.osm.pbf")
    nodes = [(k, 139 + k * 1e-3, -35 - k * 1e-3, [("place", "city"), ("name", f"Größe {k}")] if k % 3 == 0 else []) for k in range(1, 25)]
    ways = [(100, [1, 5, 2, 1], [("highway", "primary")]), (-7, [9], [])]
    relations = [(200, [("type", "multipolygon")], [(100, "way", "outer"), (3, "node", ""), (201, "relation", "x")])]
    osmpbf.write_pbf(path, nodes, ways, relations, dense=dense, block=10)
    read = lambda kind: s.read.format("osmpbf").option("kind", kind).load(path).collect()
    got = {r.id: (round(r.lon, 7), round(r.lat, 7), [tuple(t) for t in r.tags]) for r in read("nodes")}
    assert got == {i: (round(x, 7), round(y, 7), t) for i, x, y, t in nodes}
    assert sorted((r.id, list(r.refs), [tuple(t) for t in r.tags]) for r in read("ways")) == sorted(ways)
    (rel,) = read("relations")
    assert (rel.id, [tuple(t) for t in rel.tags], [tuple(m) for m in rel.members]) == relations[0]
    with open(path, "rb") as f:
        data = f.read()
    cut = str(tmp_path / "cut.pbf")
    with open(cut, "wb") as f:
        f.write(data[:-5])
    assert len([*osmpbf.blobs(cut)]) == len([*osmpbf.blobs(path)]) - 1


def test_untagged_dense_nodes_stay(s, tmp_path):
    path = str(tmp_path / "y.osm.pbf")
    osmpbf.write_pbf(path, [(1, 1.0, 2.0, []), (2, 1.5, 2.5, [])], [], [])
    assert s.read.format("osmpbf").load(path).count() == 2


def test_shapefile(s, tmp_path):
    path = str(tmp_path / "w.shp")
    square = lambda x, n: [(x, 0.0), (x, n), (x + n, n), (x + n, 0.0), (x, 0.0)]
    shapefile.write_shp(path, [[square(0.0, 10.0), square(2.0, 2.0)[::-1], square(20.0, 5.0)], [square(50.0, 1.0)]])
    got = s.read.format("shp").load(path).collect()
    assert sorted((r.id, len(r.rings), len(r.rings[0])) for r in got) == [(1, 1, 4), (1, 2, 4), (2, 1, 4)]


def test_archive(s, tmp_path):
    tiles = [(z, x, y, f"tile-{min(x, 5)}".encode()) for z, x, y in [(0, 0, 0), (1, 0, 0), (1, 1, 0), (3, 4, 5)] + [(13, x, 7) for x in range(300)]]
    df = s.createDataFrame([(archive_id_int(z, x, y), d) for z, x, y, d in tiles], "tile_id BIGINT, data BINARY")
    path = str(tmp_path / "a.pmtiles")
    header = pmtiles.write_archive(df, path, str(tmp_path), zooms=[0, 1, 3, 13])
    assert header.addressed == len(tiles) and header.contents == 6 and header.entries < len(tiles)
    got = {(r.z, r.x, r.y): bytes(r.data) for r in s.read.format("pmtiles").load(path).collect()}
    assert got == {(z, x, y): d for z, x, y, d in tiles}
    a = pmtiles.Archive(path)
    assert a.zooms == [0, 1, 3, 13] and a.tile(13, 299, 7) == b"tile-5" and a.tile(13, 300, 7) is None
    assert a.tiles([(13, 3, 7), (13, 6000, 7), (13, 7, 7)]) == [b"tile-3", None, b"tile-5"]


def test_archive_with_leaves(s, tmp_path):
    df = s.createDataFrame([(archive_id_int(13, x, 0), f"tile-{x}".encode()) for x in range(6000)], "tile_id BIGINT, data BINARY")
    path = str(tmp_path / "b.pmtiles")
    pmtiles.write_archive(df, path, str(tmp_path), zooms=[13])
    a = pmtiles.Archive(path)
    assert any(e.run_length == 0 for e in a.root)
    assert all(a.tile(13, x, 0) == f"tile-{x}".encode() for x in (0, 1, 1234, 4095, 4096, 5999)) and a.tile(13, 6000, 0) is None


def test_tile_of_id_is_the_way_back():
    assert all(pmtiles.tile_of(archive_id_int(z, x, y)) == (z, x, y) for z, x, y in [(0, 0, 0), (1, 1, 0), (5, 17, 30), (14, 16383, 1)])


def test_http_ranges():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, self.headers["Range"][6:].split("-"))
            self.send_response(206 if self.path == "/ok" else 200)
            self.end_headers()
            self.wfile.write(bytes(range(256))[a : b + 1])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert ranges.open_ranges(f"{url}/ok").read(10, 5) == bytes(range(10, 15))
    with pytest.raises(OSError):
        ranges.open_ranges(f"{url}/no").read(0, 1)
    server.shutdown()


def test_tables_are_used_again(s, tmp_path):
    from quadrille.operators.storage import reused

    made = []

    def make():
        made.append(1)
        return s.range(3)

    for key in ("a", "a", "b"):
        assert reused(make, s, f"file://{tmp_path}/t", key).count() == 3
    assert len(made) == 2


def test_section_index_inflates_only_what_a_kind_needs(s, tmp_path, monkeypatch):
    path = str(tmp_path / "z.osm.pbf")
    osmpbf.write_pbf(path, [(k, 1.0, 2.0, []) for k in range(1, 401)], [(k, [1, 2], []) for k in range(1, 51)], [(1, [], [(1, "way", "")])], block=10)
    data = [(at, n) for kind, at, n in osmpbf.blobs(path) if kind == "OSMData"]
    assert [len(osmpbf.section(path, data, k)) for k in osmpbf.KINDS] == [40, 5, 1] and osmpbf.is_sorted(path)
    assert [s.read.format("osmpbf").option("kind", k).load(path).count() for k in osmpbf.KINDS] == [400, 50, 1]
    only = str(tmp_path / "w.osm.pbf")
    osmpbf.write_pbf(only, [], [(k, [1], []) for k in range(1, 31)], [], block=10)
    data = [(at, n) for kind, at, n in osmpbf.blobs(only) if kind == "OSMData"]
    assert [len(osmpbf.section(only, data, k)) for k in osmpbf.KINDS] == [0, 3, 0]
    monkeypatch.setattr(osmpbf, "is_sorted", lambda _: False)
    assert len(osmpbf.section(only, data, "nodes")) == 3


def test_archive_filters_choose_leaves(s, tmp_path, monkeypatch):
    monkeypatch.setattr(pmtiles.P, "LEAF_LEAST", 50)
    monkeypatch.setattr(pmtiles.P, "LEAF_DIVISOR", 10**9)
    tiles = [(z, x, y) for z in (3, 4, 5) for x in range(1 << z) for y in range(1 << z)]
    df = s.createDataFrame([(archive_id_int(*t), f"{t}".encode()) for t in tiles], "tile_id BIGINT, data BINARY")
    path = str(tmp_path / "f.pmtiles")
    pmtiles.write_archive(df, path, str(tmp_path), zooms=[3, 4, 5])
    read = s.read.format("pmtiles").load(path)
    assert {(r.z, r.x, r.y) for r in read.where("z = 4").collect()} == {t for t in tiles if t[0] == 4}
    assert {(r.z, r.x, r.y) for r in read.where("z > 3 AND z <= 4").collect()} == {t for t in tiles if t[0] == 4}
    one = archive_id_int(5, 7, 9)
    assert [bytes(r.data) for r in read.where(f"tile_id = {one}").collect()] == [b"(5, 7, 9)"] and read.where("z IN (3, 5)").count() == 64 + 1024 and read.count() == len(tiles)
    r = pmtiles.PmTilesReader(path)
    every = len(r.partitions())
    [*r.pushFilters([pmtiles.EqualTo(("tile_id",), one)])]
    assert every > 10 and len(r.partitions()) == 1 and len([*r.read(r.partitions()[0])]) == 1
