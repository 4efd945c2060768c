"""Tile archives: spark.read.format("pmtiles"), lookups, and a writer that lays contents out by windows and joins."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.tileid import archive_id_int
from ..kernels import pmtiles as P
from ..operators import archive as A
from ..operators.sequences import running_sum
from .ranges import Ranges, open_ranges

SCHEMA = "tile_id BIGINT, z INT, x INT, y INT, data BINARY"
#: Bytes of tiles that a partition reads, about.
PART_BYTES = 32 << 20


def tile_of(tile_id: int) -> tuple[int, int, int]:
    """(z, x, y) of an archive id: the Hilbert curve backwards."""
    z = 0
    while ((1 << 2 * (z + 1)) - 1) // 3 <= tile_id:
        z += 1
    d, x, y = tile_id - ((1 << 2 * z) - 1) // 3, 0, 0
    for k in range(z):
        side = 1 << k
        rx, ry = d >> 1 & 1, (d ^ d >> 1) & 1
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y, d = x + side * rx, y + side * ry, d >> 2
    return z, x, y


class Archive:
    """An open archive: header, root and zooms are read at once, leaves when asked for."""

    def __init__(self, path: str) -> None:
        self.ranges: Ranges = open_ranges(path)
        self.header = P.Header.parse(self.ranges.read(0, P.HEADER_SIZE))
        self.root = P.read_directory(self.ranges.read(*self.header.root)) if self.header.root[1] else []
        self.zooms = P.read_zooms(self.ranges.read(*self.header.metadata)) or list(range(self.header.zooms[0], self.header.zooms[1] + 1))
        self.leaves: dict[int, list[P.Entry]] = {}

    def leaf(self, e: P.Entry) -> list[P.Entry]:
        """Of the 256 leaves used last, or read; the dict is in order of use."""
        found = self.leaves.pop(e.offset, None)
        if found is None:
            if len(self.leaves) >= 256:
                del self.leaves[next(iter(self.leaves))]
            found = P.read_directory(self.ranges.read(self.header.leaves[0] + e.offset, e.length))
        self.leaves[e.offset] = found
        return found

    def locate(self, z: int, x: int, y: int) -> tuple[int, int] | None:
        tile_id = archive_id_int(z, x, y)
        e = P.find(self.root, tile_id)
        while e is not None and e.run_length == 0:
            e = P.find(self.leaf(e), tile_id)
        return e and (e.offset, e.length)

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        return self.tiles([(z, x, y)])[0]

    def tiles(self, wanted: list[tuple[int, int, int]]) -> list[bytes | None]:
        """In the order asked for; ranges that lie close together are read as one."""
        found = [self.locate(*w) for w in wanted]
        return self.contents(found)

    def contents(self, places: list[tuple[int, int] | None]) -> list[bytes | None]:
        """The bytes at each (offset, length); what lies close together is read at once."""
        blocks = P.coalesce([*{p for p in places if p}])
        starts = [a for a, _ in blocks]
        data = [self.ranges.read(self.header.data[0] + a, n) for a, n in blocks]
        return [p and data[k := bisect_right(starts, p[0]) - 1][p[0] - starts[k] : p[0] - starts[k] + p[1]] for p in places]

    def entries(self) -> Iterator[P.Entry]:
        for e in self.root:
            yield from self.leaf(e) if e.run_length == 0 else (e,)


class _Part(InputPartition):
    """Entries of the root directory: contents, or leaves that the task reads."""

    def __init__(self, entries: list[tuple[int, int, int, int]]) -> None:
        self.entries = entries


def first_id(z: int) -> int:
    return ((1 << 2 * z) - 1) // 3


class PmTilesReader(DataSourceReader):
    """A partition for each leaf directory. Filters on z and tile_id choose the leaves and the entries in them that are read."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.low, self.high = 0, 1 << 62  # tile ids wanted

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            ids = (lambda v: (v, v + 1)) if name == ("tile_id",) else (lambda v: (first_id(v), first_id(v + 1)))
            if name in (("tile_id",), ("z",)) and isinstance(f, In) and f.value:
                self._narrow(min(ids(v)[0] for v in f.value), max(ids(v)[1] for v in f.value))
            elif name in (("tile_id",), ("z",)) and isinstance(value, int) and value >= 0:
                low, high = ids(value)
                bounds = {EqualTo: (low, high), GreaterThan: (high, None), GreaterThanOrEqual: (low, None), LessThan: (None, low), LessThanOrEqual: (None, high)}
                self._narrow(*bounds.get(type(f), (None, None)))
            yield f  # Spark checks the rows again

    def _narrow(self, low: int | None, high: int | None) -> None:
        self.low, self.high = max(self.low, low or 0), min(self.high, self.high if high is None else high)

    def partitions(self) -> list[InputPartition]:
        root = Archive(self.path).root
        parts: list[list[tuple]] = [[]]
        for k, e in enumerate(root):
            after = root[k + 1].tile_id if k + 1 < len(root) and not e.run_length else e.tile_id + e.run_length if e.run_length else 1 << 62
            if e.tile_id < self.high and after > self.low:
                if not e.run_length or len(parts[-1]) >= 4096 or sum(x[2] for x in parts[-1]) >= PART_BYTES:
                    parts.append([])
                parts[-1].append(tuple(e))
                if not e.run_length:
                    parts.append([])
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        a = Archive(self.path)
        entries = [x for e in partition.entries for x in (a.leaf(P.Entry(*e)) if not e[3] else [P.Entry(*e)])]
        entries = [e for e in entries if e.tile_id < self.high and e.tile_id + e.run_length > self.low]
        for at in range(0, len(entries), 1000):
            some = entries[at : at + 1000]
            for e, data in zip(some, a.contents([(e.offset, e.length) for e in some]), strict=True):
                for tile_id in range(max(e.tile_id, self.low), min(e.tile_id + e.run_length, self.high)):
                    yield (tile_id, *tile_of(tile_id), data)


class PmTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PmTilesReader(self.options["path"])


def write_archive(tiles: DataFrame, path: str, folder: str, *, zooms: list[int], bounds_e7: tuple[int, int, int, int] = (0, 0, 0, 0)) -> P.Header:
    """tiles (tile_id, data; each id once, a table that reads the same twice) as one archive at a local or Arrow path.

    Contents and offsets come from the layout operators. Tasks write their ranges of contents as part files in `folder`, a
    shared one; the driver joins the parts, leaf by leaf directories and header into the file: it streams, and holds one
    directory leaf for each 4,096 entries or more."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    placed = A.layout(A.contents(tiles))
    firsts = tiles.join(placed.select(F.col("first_id").alias("tile_id")), "tile_id", "left_semi").select("tile_id", "data")
    parts_dir = f"{folder}/parts-{uuid.uuid4().hex}"
    opened = lambda p: FileSystem.from_uri(p) if "://" in p else (LocalFileSystem(), p)
    fs, base = opened(parts_dir)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = opened(parts_dir)
        name, out, first, size = f"{at}/{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            for tile_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out, first = where.open_output_stream(name), tile_id
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "name": name, "size": size}])

    parts = firsts.repartitionByRange("tile_id").sortWithinPartitions("tile_id").mapInArrow(write, "first BIGINT, name STRING, size BIGINT").collect()
    entries = A.directory(tiles, placed)
    n = entries.count()
    size = max(n // P.LEAF_DIVISOR, P.LEAF_LEAST)
    ranked = running_sum(entries, F.lit(1).cast("bigint"), "tile_id", "rank").withColumn("leaf", F.floor(F.col("rank") / size))

    def leaf(table: pa.Table) -> pa.Table:
        rows = sorted(P.Entry(*r) for r in zip(*(table.column(k).to_pylist() for k in ("tile_id", "offset", "length", "run_length")), strict=True))
        return pa.table({"first": pa.array([rows[0].tile_id], pa.int64()), "data": pa.array([P.write_directory(rows)], pa.binary())})

    leaves = sorted((r.first, bytes(r.data)) for r in ranked.groupBy("leaf").applyInArrow(leaf, "first BIGINT, data BINARY").toLocalIterator())
    root, tail = (leaves[0][1] if leaves else P.write_directory([])), b""
    if len(leaves) > 1 or len(root) > P.ROOT_MOST:
        at, marks = 0, []
        for first, data in leaves:
            marks.append(P.Entry(first, at, len(data), 0))
            at += len(data)
        root, tail = P.write_directory(marks), b"".join(d for _, d in leaves)
    stats = A.stats(entries).first()
    metadata = P.write_metadata(zooms)
    at, places = P.HEADER_SIZE, []
    for block in (len(root), len(metadata), len(tail), sum(p.size for p in parts)):
        places.append((at, block))
        at += block
    header = P.Header(*places, stats.addressed or 0, stats.entries, stats.contents, zooms=(min(zooms, default=0), max(zooms, default=0)), bounds_e7=bounds_e7, center_zoom=min(zooms, default=0), center_e7=((bounds_e7[0] + bounds_e7[2]) // 2, (bounds_e7[1] + bounds_e7[3]) // 2))
    to, target = opened(path)
    with to.open_output_stream(f"{target}.new") as out:
        for block in (header.to_bytes(), root, metadata, tail):
            out.write(block)
        for p in sorted(parts, key=lambda p: p.first):
            with fs.open_input_stream(p.name) as f:
                while chunk := f.read(8 << 20):
                    out.write(chunk)
    to.move(f"{target}.new", target)
    fs.delete_dir(base)
    return header
