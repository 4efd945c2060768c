"""Polygon shapefiles (.shp): spark.read.format("shp"), one row for each polygon, holes with their outer ring."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..kernels.areas import area, assign_holes
from .ranges import open_ranges

SCHEMA = "id BIGINT, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
POLYGON = 5
PART_BYTES = 32 << 20


def polygons(record: bytes) -> list[list[list[tuple[float, float]]]]:
    """Open rings of each polygon of a record: clockwise rings are outer ones, others go to the outer that they lie in."""
    (kind,) = struct.unpack_from("<i", record)
    if kind == 0:
        return []
    if kind != POLYGON:
        raise ValueError(f"shape type {kind}; only polygons are read")
    n_parts, n_points = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    points = np.frombuffer(record, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2).tolist()
    rings = [[*map(tuple, points[a:b])] for a, b in zip(starts, starts[1:], strict=False)]
    rings = [r[:-1] if r[0] == r[-1] else r for r in rings if len(r) >= 3]
    outers, holes = [r for r in rings if area(r) < 0], [r for r in rings if area(r) > 0]
    return [[*p] for p in assign_holes(outers, holes)]


class _Part(InputPartition):
    def __init__(self, places: list[tuple[int, int, int]]) -> None:
        self.places = places


class ShapeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        ranges = open_ranges(self.path)
        size, at = ranges.size(), 100
        if struct.unpack(">i", ranges.read(0, 4))[0] != 9994:
            raise ValueError("not a shapefile")
        parts: list[list[tuple[int, int, int]]] = [[]]
        total = 0
        while at + 8 <= size:
            number, words = struct.unpack(">ii", ranges.read(at, 8))
            if total >= PART_BYTES:
                parts.append([])
                total = 0
            parts[-1].append((number, at + 8, 2 * words))
            total += 2 * words
            at += 8 + 2 * words
        return [*map(_Part, parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        ranges = open_ranges(self.path)
        for number, at, n in partition.places:
            for polygon in polygons(ranges.read(at, n)):
                yield number, [[{"x": x, "y": y} for x, y in ring] for ring in polygon]


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapeReader(self.options["path"])


def write_shp(path: str, records: list[list[list[tuple[float, float]]]]) -> None:
    """Records of closed rings, as a file at a local or Arrow path."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, target = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
    body = bytearray()
    for k, rings in enumerate(records, 1):
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts = np.cumsum([0, *(len(r) for r in rings)])[:-1]
        rec = struct.pack("<i4dii", POLYGON, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + starts.astype("<i4").tobytes() + np.array(points, "<f8").tobytes()
        body += struct.pack(">ii", k, len(rec) // 2) + rec
    head = struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, POLYGON, *[0.0] * 8)
    with fs.open_output_stream(target) as f:
        f.write(head + bytes(body))
