"""A tile's payload: records as columns, coordinates as zig-zag differences, zstd around it."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np
import zstandard

from .varint import pack_bits, unpack_bits

# Fixed values of the format.
TILE_VERSION, NO_NAME, ZSTD_LEVEL = 2, 65535, 9
_HEAD, _ROAD, _AREA, _LABEL, _POI = struct.Struct("<BBHHHHHHH"), struct.Struct("<BBbBBBHH"), struct.Struct("<BbBBHH"), struct.Struct("<BBhhH"), struct.Struct("<BBhh")


def _coded(lines: list[list[tuple[int, int]]]) -> bytes:
    """Each line's differences from (0, 0) on, 16 bits each."""
    parts = []
    for line in lines:
        d = np.diff(np.array(line, np.int64).reshape(-1, 2), axis=0, prepend=np.zeros((1, 2), np.int64))
        parts.append((((d << 1) ^ (d >> 63)) & 65535).astype("<u2").tobytes())
    return b"".join(parts)


def encode(records: list[dict[str, Any]], extent: int = 8192) -> bytes:
    """records: dicts with shape and the fields of their shape (see decode). Too many of anything for its counter is an error."""
    by: dict[str, list[dict[str, Any]]] = {"road": [], "area": [], "label": [], "poi": []}
    for r in records:
        by[r["shape"]].append(r)
    names: dict[str, int] = {}
    number = lambda n: NO_NAME if n is None else names.setdefault(n, len(names))
    roads = b"".join(_ROAD.pack(r["kind"], r["start"] | r["end"] << 2 | r["structure"] << 4, r["layer"], r["lanes_fwd"], r["lanes_bwd"], 0, len(r["coords"]), number(r.get("name"))) for r in by["road"])
    areas, rings, clips = [], [], []
    for a in by["area"]:
        areas.append(_AREA.pack(a["kind"], a["layer"], a["floors"], 0, len(rings), len(a["rings"])))
        rings += a["rings"]
        clips += [f for ring in a.get("clip") or [[False] * len(r) for r in a["rings"]] for f in ring]
    labels = b"".join(_LABEL.pack(x["class"], x["class"], *x["anchor"], number(x["name"])) for x in by["label"])
    pois = b"".join(_POI.pack(x["kind"], 0, *x["anchor"]) for x in by["poi"])
    if len(names) >= NO_NAME:
        raise ValueError("too many names in a tile")
    head = _HEAD.pack(TILE_VERSION, int(any(clips)), extent, len(by["road"]), len(areas), len(rings), len(by["label"]), len(by["poi"]), len(names))
    text = b"".join(struct.pack("<H", len(b := n.encode())) + b for n in names)
    counts = np.array([len(r) for r in rings], np.int64)
    if len(counts) and counts.max() > 65535:
        raise ValueError("too many vertices in a ring")
    body = b"".join([head, roads, *areas, counts.astype("<u2").tobytes(), labels, pois, _coded([r["coords"] for r in by["road"]]), _coded(rings), text, pack_bits(clips) if any(clips) else b""])
    return zstandard.ZstdCompressor(ZSTD_LEVEL).compress(body)


def decode(data: bytes) -> list[dict[str, Any]]:
    """The records in their sections' order; ValueError if anything is out of place."""
    try:
        return _decode(zstandard.ZstdDecompressor().decompressobj().decompress(data))
    except (struct.error, zstandard.ZstdError, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"a tile is damaged: {e}") from e


def _decode(body: bytes) -> list[dict[str, Any]]:
    version, flags, _, n_roads, n_areas, n_rings, n_labels, n_pois, n_names = _HEAD.unpack_from(body)
    if version != TILE_VERSION:
        raise ValueError(f"tile version {version}")
    at = _HEAD.size

    def table(kind: struct.Struct, n: int) -> list[tuple]:
        nonlocal at
        rows = [kind.unpack_from(body, at + k * kind.size) for k in range(n)]
        at += n * kind.size
        return rows

    roads, areas = table(_ROAD, n_roads), table(_AREA, n_areas)
    counts = [r[0] for r in table(struct.Struct("<H"), n_rings)]
    labels, pois = table(_LABEL, n_labels), table(_POI, n_pois)

    def line(n: int) -> list[tuple[int, int]]:
        nonlocal at
        if at + 4 * n > len(body):
            raise ValueError("the coordinates end too early")
        v = np.frombuffer(body, "<u2", 2 * n, at).astype(np.int32)
        at += 4 * n
        return [*map(tuple, np.cumsum(((v >> 1) ^ -(v & 1)).reshape(-1, 2), axis=0).tolist())]

    coords, rings = [line(r[6]) for r in roads], [line(n) for n in counts]
    names = []
    for _ in range(n_names):
        (size,) = struct.unpack_from("<H", body, at)
        names.append(body[at + 2 : at + 2 + size].decode())
        at += 2 + size
    flat = unpack_bits(body[at:], sum(counts)) if flags & 1 else [False] * sum(counts)
    ends = np.cumsum([0, *counts]).tolist()
    name = lambda k: None if k == NO_NAME else names[k]
    out: list[dict[str, Any]] = [{"shape": "road", "kind": k, "start": c & 3, "end": c >> 2 & 3, "structure": c >> 4 & 3, "layer": layer, "lanes_fwd": f, "lanes_bwd": b, "name": name(n), "coords": line_} for (k, c, layer, f, b, _, _, n), line_ in zip(roads, coords, strict=True)]
    out += [{"shape": "area", "kind": k, "layer": layer, "floors": floors, "rings": rings[a : a + n], "clip": [flat[ends[j] : ends[j + 1]] for j in range(a, a + n)]} for k, layer, floors, _, a, n in areas]
    out += [{"shape": "label", "class": k, "anchor": (x, y), "name": name(n)} for k, _, x, y, n in labels]
    return out + [{"shape": "poi", "kind": k, "anchor": (x, y)} for k, _, x, y in pois]
