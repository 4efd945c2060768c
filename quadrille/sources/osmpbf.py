"""OpenStreetMap PBF files: spark.read.format("osmpbf").option("kind", "nodes" | "ways" | "relations"), and a small writer."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..kernels.varint import read_all, read_uvarint, unzigzag, write_all, write_uvarint, zigzag
from .ranges import open_ranges

TAGS = "tags ARRAY<STRUCT<k: STRING, v: STRING>>"
SCHEMAS = {"nodes": f"id BIGINT, lon DOUBLE, lat DOUBLE, {TAGS}", "ways": f"id BIGINT, refs ARRAY<BIGINT>, {TAGS}", "relations": f"id BIGINT, {TAGS}, members ARRAY<STRUCT<id: BIGINT, type: STRING, role: STRING>>"}
# Fixed values of the format.
MEMBER_TYPES = ("node", "way", "relation")
FEATURES = ("OsmSchema-V0.6", "DenseNodes", "Sort.Type_then_ID", "LocationsOnWays")
#: Bytes of blobs that a partition reads, about.
PART_BYTES = 32 << 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
            yield key >> 3, value
        elif key & 7 == 2:
            n, at = _number(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {key & 7}")


def _number(data: bytes, at: int) -> tuple[int, int]:
    if (got := read_uvarint(data, at)) is None:
        raise ValueError("the message ends within a number")
    return got


def _first(data: bytes) -> dict[int, int | bytes]:
    return dict(reversed([*fields(data)]))


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset of the blob, size) of the whole blobs of a file; an incomplete last one ends it."""
    ranges, at = open_ranges(path), 0
    size = ranges.size()
    while at + 4 <= size:
        (n,) = struct.unpack(">I", ranges.read(at, 4))
        if at + 4 + n > size:
            return
        head = _first(ranges.read(at + 4, n))
        kind, length = bytes(head[1]).decode(), int(head[3])
        if at + 4 + n + length > size:
            return
        yield kind, at + 4 + n, length
        at += 4 + n + length


def inflate(blob: bytes) -> bytes:
    got = _first(blob)
    if 3 in got:
        return zlib.decompress(got[3])
    if 1 in got:
        return bytes(got[1])
    raise ValueError("a blob is compressed by a method that isn't zlib")


def check_header(path: str) -> None:
    for kind, at, n in blobs(path):
        if kind == "OSMHeader":
            unknown = [v for k, v in fields(inflate(open_ranges(path).read(at, n))) if k == 4 and bytes(v).decode() not in FEATURES]
            if unknown:
                raise ValueError(f"the file needs features that this reader lacks: {unknown}")
        return


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _tags(strings: list[str], keys: bytes, values: bytes) -> list[dict[str, str]]:
    return [{"k": strings[k], "v": strings[v]} for k, v in zip(read_all(keys).tolist(), read_all(values).tolist(), strict=False)]


def decode(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of one kind of a primitive block."""
    strings: list[str] = []
    groups, granularity, lat_offset, lon_offset = [], 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat_offset = _signed(v)
        elif k == 20:
            lon_offset = _signed(v)
    degrees = lambda c, offset: 1e-9 * (c * granularity + offset)
    for g in groups:
        for k, v in fields(g):
            if k == 1 and kind == "nodes":
                f = _first(v)
                lat, lon = (int(unzigzag(np.array([f.get(n, 0)], np.uint64))[0]) for n in (8, 9))
                yield int(unzigzag(np.array([f[1]], np.uint64))[0]), degrees(lon, lon_offset), degrees(lat, lat_offset), _tags(strings, f.get(2, b""), f.get(3, b""))
            elif k == 2 and kind == "nodes":
                f = _first(v)
                ids, lats, lons = (np.cumsum(unzigzag(read_all(f.get(n, b"")))) for n in (1, 8, 9))
                flat = read_all(f.get(10, b"")).astype(np.int64)
                cuts = np.flatnonzero(flat == 0)  # a key of 0 ends a node's tags; values are never 0
                parts = np.split(flat, cuts + 1)[: len(cuts)] or [flat[:0]] * len(ids)  # untagged nodes only: no list at all
                for i, la, lo, p in zip(ids.tolist(), lats.tolist(), lons.tolist(), parts, strict=True):
                    kv = p[:-1].tolist()
                    yield i, degrees(lo, lon_offset), degrees(la, lat_offset), [{"k": strings[a], "v": strings[b]} for a, b in zip(kv[::2], kv[1::2], strict=True)]
            elif k == 3 and kind == "ways":
                f = _first(v)
                yield _signed(f[1]), np.cumsum(unzigzag(read_all(f.get(8, b"")))).tolist(), _tags(strings, f.get(2, b""), f.get(3, b""))
            elif k == 4 and kind == "relations":
                f = _first(v)
                ids = np.cumsum(unzigzag(read_all(f.get(9, b"")))).tolist()
                members = [{"id": i, "type": MEMBER_TYPES[t], "role": strings[r]} for i, t, r in zip(ids, read_all(f.get(10, b"")).tolist(), read_all(f.get(8, b"")).tolist(), strict=True)]
                yield _signed(f[1]), _tags(strings, f.get(2, b""), f.get(3, b"")), members


KINDS = ("nodes", "ways", "relations")


def kinds_of(block: bytes) -> tuple[int, int] | None:
    """The first and the last of KINDS in a primitive block; None if it is empty."""
    found = [min(max(k - 2, 0), 2) for n, g in fields(block) if n == 2 for k, _ in fields(g) if 1 <= k <= 4]
    return (min(found), max(found)) if found else None


def is_sorted(path: str) -> bool:
    """Whether the file says that nodes come before ways and ways before relations."""
    for kind, at, n in blobs(path):
        head = inflate(open_ranges(path).read(at, n)) if kind == "OSMHeader" else b""
        return any(k in (4, 5) and bytes(v) == b"Sort.Type_then_ID" for k, v in fields(head))
    return False


def section(path: str, places: list[tuple[int, int]], kind: str) -> list[tuple[int, int]]:
    """Of the data blobs of a sorted file those that may hold the kind, by bisection: two blobs are inflated for each halving. All blobs of a file that isn't sorted."""
    if not is_sorted(path):
        return places
    ranges, wanted, seen = open_ranges(path), KINDS.index(kind), {}

    def kinds(k: int) -> tuple[int, int]:
        """Of blob k, or of the next one that isn't empty."""
        while k < len(places) and k not in seen:
            seen[k] = kinds_of(inflate(ranges.read(*places[k])))
            if seen[k] is None:
                seen[k] = kinds(k + 1)
        return seen[k] if k < len(places) else (len(KINDS), len(KINDS))

    first = bisect_left(range(len(places)), True, key=lambda k: kinds(k)[1] >= wanted)
    return places[first : bisect_left(range(len(places)), True, lo=first, key=lambda k: kinds(k)[0] > wanted)]


class _Part(InputPartition):
    def __init__(self, places: list[tuple[int, int]]) -> None:
        self.places = places


class OsmPbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        check_header(self.path)
        parts: list[list[tuple[int, int]]] = [[]]
        size = 0
        data = [(at, n) for kind, at, n in blobs(self.path) if kind == "OSMData"]  # headers only
        for at, n in section(self.path, data, self.kind):
            if size >= PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append((at, n))
            size += n
        return [*map(_Part, parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        ranges = open_ranges(self.path)
        for at, n in partition.places:
            yield from decode(inflate(ranges.read(at, n)), self.kind)


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return OsmPbfReader(self.options["path"], self.options.get("kind", "nodes"))


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return write_uvarint(number << 3) + write_uvarint(value & (1 << 64) - 1)
    return write_uvarint(number << 3 | 2) + write_uvarint(len(value)) + value


def _steps(values: list[int]) -> bytes:
    return write_all(zigzag(np.diff(np.array(values, np.int64), prepend=0)).tolist())


def _blob(kind: str, body: bytes) -> bytes:
    blob = _field(2, len(body)) + _field(3, zlib.compress(body))
    head = _field(1, kind.encode()) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def _header() -> bytes:
    return _blob("OSMHeader", b"".join(_field(4, f.encode()) for f in FEATURES[:2]) + _field(5, FEATURES[2].encode()))


def data_blob(kind: str, part: list[tuple], dense: bool = True) -> bytes:
    """A data blob of rows in the order of the kind's schema, with tags as (key, value) pairs and members as (id, type, role)."""
    strings = {"": 0}
    sid = lambda s: strings.setdefault(s, len(strings))
    tagged = lambda tags: _field(2, write_all([sid(k) for k, _ in tags])) + _field(3, write_all([sid(v) for _, v in tags]))
    if kind == "nodes" and dense:
        flat = [x for *_, tags in part for x in (*(sid(s) for kv in tags for s in kv), 0)] if any(r[3] for r in part) else []
        lons, lats = ([round(r[k] * 1e7) for r in part] for k in (1, 2))
        group = _field(2, _field(1, _steps([r[0] for r in part])) + _field(8, _steps(lats)) + _field(9, _steps(lons)) + (_field(10, write_all(flat)) if flat else b""))
    elif kind == "nodes":
        z = lambda v: int(zigzag(np.array([v]))[0])
        group = b"".join(_field(1, _field(1, z(i)) + tagged(tags) + _field(8, z(round(lat * 1e7))) + _field(9, z(round(lon * 1e7)))) for i, lon, lat, tags in part)
    elif kind == "ways":
        group = b"".join(_field(3, _field(1, i) + tagged(tags) + _field(8, _steps(refs))) for i, refs, tags in part)
    else:
        group = b"".join(_field(4, _field(1, i) + tagged(tags) + _field(8, write_all([sid(m[2]) for m in members])) + _field(9, _steps([m[0] for m in members])) + _field(10, write_all([MEMBER_TYPES.index(m[1]) for m in members]))) for i, tags, members in part)
    return _blob("OSMData", _field(1, b"".join(_field(1, s.encode()) for s in strings)) + _field(2, group))


def write_pbf(path: str, nodes: list[tuple], ways: list[tuple], relations: list[tuple], *, dense: bool = True, block: int = 8000) -> None:
    """Rows in the orders of SCHEMAS, with tags as (key, value) pairs and members as (id, type, role), as a local file."""
    out = [_header()]
    for kind, rows in zip(KINDS, (nodes, ways, relations), strict=True):
        out += [data_blob(kind, rows[at : at + block], dense) for at in range(0, len(rows), block)]
    with open(path, "wb") as f:
        f.write(b"".join(out))


def write_extract(path: str, tables: dict[str, DataFrame], block: int = 8000) -> None:
    """Tables of SCHEMAS as one file, sorted by kind and id. Tasks make the blobs; the driver holds those of one partition at a time."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, target = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
    with fs.open_output_stream(target) as out:
        out.write(_header())
        for kind in KINDS:

            def run(batches: Iterable[pa.RecordBatch], kind: str = kind) -> Iterator[pa.RecordBatch]:
                names = [c.split()[0] for c in SCHEMAS[kind].split(", ") if c.split()[0] in ("id", "lon", "lat", "refs", "tags", "members")]
                for batch in batches:
                    for at in range(0, batch.num_rows, block):
                        rows = batch.slice(at, block).to_pylist()
                        made = [tuple([tuple(x.values()) for x in r[n]] if n in ("tags", "members") else r[n] for n in names) for r in rows]
                        yield pa.RecordBatch.from_pydict({"blob": pa.array([data_blob(kind, made)], pa.binary())})

            for r in tables[kind].sort("id").mapInArrow(run, "blob BINARY").toLocalIterator():
                out.write(bytes(r.blob))
