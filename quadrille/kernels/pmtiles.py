"""The tile archive's bytes: header, directories, metadata."""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from .varint import read_all, write_all

# Fixed values of the format.
MAGIC, VERSION, HEADER_SIZE, ROOT_MOST = b"PMTiles", 3, 127, 16 * 1024
_HEADER = struct.Struct("<7sB11Q6B4iB2i")
LEAF_LEAST, LEAF_DIVISOR = 4096, 3500
#: Gap between two wanted ranges up to which they are read as one.
GAP = 64 * 1024


class Entry(NamedTuple):
    """run_length 0: a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run_length: int


@dataclass
class Header:
    root: tuple[int, int] = (0, 0)
    metadata: tuple[int, int] = (0, 0)
    leaves: tuple[int, int] = (0, 0)
    data: tuple[int, int] = (0, 0)
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: int = 1
    internal_compression: int = 1
    tile_compression: int = 1
    tile_type: int = 0
    zooms: tuple[int, int] = (0, 0)
    bounds_e7: tuple[int, int, int, int] = (0, 0, 0, 0)
    center_zoom: int = 0
    center_e7: tuple[int, int] = field(default=(0, 0))

    def to_bytes(self) -> bytes:
        return _HEADER.pack(MAGIC, VERSION, *self.root, *self.metadata, *self.leaves, *self.data, self.addressed, self.entries, self.contents, self.clustered, self.internal_compression, self.tile_compression, self.tile_type, *self.zooms, *self.bounds_e7, self.center_zoom, *self.center_e7)

    @staticmethod
    def parse(data: bytes) -> Header:
        if len(data) < HEADER_SIZE or data[:7] != MAGIC or data[7] != VERSION:
            raise ValueError("not a version 3 tile archive")
        v = _HEADER.unpack_from(data)[2:]
        return Header(v[0:2], v[2:4], v[4:6], v[6:8], *v[8:11], *v[11:15], v[15:17], v[17:21], v[21], v[22:24])


def write_directory(entries: list[Entry]) -> bytes:
    """Column by column: count, id differences, run lengths, lengths, offsets (0: right after the entry before)."""
    ids = [e.tile_id for e in entries]
    gaps = [a - b for a, b in zip(ids, [0, *ids[:-1]], strict=True)]
    offsets = [0 if k and entries[k - 1].offset + entries[k - 1].length == e.offset else e.offset + 1 for k, e in enumerate(entries)]
    return write_all([len(entries), *gaps, *(e.run_length for e in entries), *(e.length for e in entries), *offsets])


def read_directory(data: bytes) -> list[Entry]:
    v = read_all(data).astype(np.int64)
    if not len(v) or len(v) != 1 + 4 * v[0]:
        raise ValueError("a directory is damaged")
    gaps, runs, lengths, codes = v[1:].reshape(4, -1)
    offsets = codes - 1
    for k in np.flatnonzero(codes == 0).tolist():
        if not k:
            raise ValueError("the first offset can't follow another")
        offsets[k] = offsets[k - 1] + lengths[k - 1]
    return [Entry(*e) for e in zip(np.cumsum(gaps).tolist(), offsets.tolist(), lengths.tolist(), runs.tolist(), strict=True)]


def find(entries: list[Entry], tile_id: int) -> Entry | None:
    """The entry that holds a tile, or the leaf that may."""
    k = bisect_right(entries, tile_id, key=lambda e: e.tile_id) - 1
    if k < 0:
        return None
    e = entries[k]
    return e if e.run_length == 0 or tile_id < e.tile_id + e.run_length else None


def directories(entries: list[Entry], root_most: int = ROOT_MOST) -> tuple[bytes, bytes]:
    """Root and leaves: all in the root if it is small enough, else leaves of ever more entries until their root is."""
    root, leaves = write_directory(entries), b""
    size = max(len(entries) // LEAF_DIVISOR, LEAF_LEAST)
    while len(root) > root_most:
        parts = [(entries[k].tile_id, write_directory(entries[k : k + size])) for k in range(0, len(entries), size)]
        ends = np.cumsum([len(p) for _, p in parts]).tolist()
        root = write_directory([Entry(i, end - len(p), len(p), 0) for (i, p), end in zip(parts, ends, strict=True)])
        leaves, size = b"".join(p for _, p in parts), 2 * size
    return root, leaves


def write_metadata(zooms: list[int]) -> bytes:
    return json.dumps({"format": "tiles", "zoom_levels": sorted(zooms)}, separators=(",", ":")).encode()


def read_zooms(data: bytes) -> list[int] | None:
    try:
        zooms = json.loads(data).get("zoom_levels")
    except (ValueError, AttributeError):
        return None
    return zooms or None


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """(offset, length) ranges, those that overlap or are `gap` apart at most as one."""
    out: list[list[int]] = []
    for at, n in sorted(ranges):
        if out and at <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], at + n)
        else:
            out.append([at, at + n])
    return [(a, b - a) for a, b in out]
