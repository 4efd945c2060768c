"""Kernels on areas: ring assembly, holes, exact clipping to a rectangle, union, rasters and contours."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np

from .lines import chains

Point = tuple[float, float]
Rect = tuple[float, float, float, float]


def area(ring: Sequence[Point]) -> float:
    """Signed: positive if counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True)) / 2


def assemble_rings(fragments: Sequence[Sequence[int]]) -> list[list[int]]:
    """Closed node sequences of at least four from fragments, turned as needed.

    At each node the ends of fragments pair up in their order. Chains of pairs that don't close are dropped with all their
    fragments; one that closes but comes to a node twice is as many rings as it has loops."""
    at: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, f in enumerate(fragments):
        if len(f) >= 2:
            at[f[0]].append((k, 0))
            at[f[-1]].append((k, 1))
    partner = {}
    for ends in at.values():
        for a, b in zip(ends[::2], ends[1::2], strict=False):
            partner[a], partner[b] = b, a
    out = []
    for chain, closes in chains(len(fragments), partner):
        if closes:
            out += _loops([fragments[k][::-1] if turn else fragments[k] for k, turn in chain])
    return [ring for ring in out if len(ring) >= 4]


def _loops(walk: Sequence[Sequence[int]]) -> list[list[int]]:
    """A closed walk over fragments, cut where it comes to an end of a fragment again."""
    out, open_, place = [], [], {walk[0][0]: 0}
    for f in walk:
        open_.append(f)
        if f[-1] in place:
            k = place[f[-1]]
            loop, open_ = open_[k:], open_[:k]
            out.append([loop[0][0], *(n for g in loop for n in g[1:])])
            place = {node: j for node, j in place.items() if j <= k}
        else:
            place[f[-1]] = len(open_)
    return out


def inside(p: Point, ring: Sequence[Point]) -> bool:
    """By the even-odd rule."""
    odd = False
    for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def assign_holes(outers: Sequence[Sequence[Point]], holes: Sequence[Sequence[Point]]) -> list[list[Sequence[Point]]]:
    """Polygons (outer, holes ...): a lone outer takes all holes, else a hole goes to the first outer that has its first vertex inside; others are dropped."""
    out: list[list[Sequence[Point]]] = [[o] for o in outers]
    for h in holes:
        to = 0 if len(outers) == 1 else next((k for k, o in enumerate(outers) if inside(h[0], o)), None)
        if to is not None and outers:
            out[to].append(h)
    return out


def clip_to_band(ring: Sequence[Point], axis: int, low: float, high: float) -> list[Point]:
    """Sutherland-Hodgman on one axis: one ring, which may run along the border where the part inside isn't connected."""
    for bound, sign in ((low, 1.0), (high, -1.0)):
        out: list[Point] = []
        depth = [(p[axis] - bound) * sign for p in ring]
        if min(depth, default=0.0) < 0:
            for k, p in enumerate(ring):
                q, before = ring[k - 1], depth[k - 1]
                if (before < 0) != (depth[k] < 0) and before and depth[k]:
                    t = before / (before - depth[k])
                    other = q[1 - axis] + (p[1 - axis] - q[1 - axis]) * t
                    out.append((bound, other) if axis == 0 else (other, bound))
                if depth[k] >= 0:
                    out.append(p)
            ring = [p for k, p in enumerate(out) if p != out[k - 1]] if len(out) > 1 else []
    return list(ring)


def slabs(rings: Sequence[Sequence[Point]], axis: int, first: int, last: int, fan: int = 8) -> Iterator[tuple[int, list[Sequence[Point]]]]:
    """What is left of a polygon in each unit band first ... last of an axis, its outer ring first: wide bands are cut to narrower ones, `fan` at a time."""
    if first == last:
        yield first, list(rings)
        return
    step = -(-(last - first + 1) // fan)
    for low in range(first, last + 1, step):
        high = min(low + step - 1, last)
        outer = clip_to_band(rings[0], axis, low, high + 1)
        if outer:
            yield from slabs([outer, *filter(None, (clip_to_band(r, axis, low, high + 1) for r in rings[1:]))], axis, low, high, fan)


def _around(p: Point, rect: Rect) -> float | None:
    """Place of a border point on the rectangle's outline, counter-clockwise from its lower left corner; None if not on it."""
    x0, y0, x1, y1 = rect
    w, h = x1 - x0, y1 - y0
    if p[1] == y0 and p[0] < x1:
        return p[0] - x0
    if p[0] == x1 and p[1] < y1:
        return w + p[1] - y0
    if p[1] == y1 and p[0] > x0:
        return w + h + x1 - p[0]
    if p[0] == x0 and p[1] > y0:
        return 2 * w + h + y1 - p[1]
    return None


def clip_polygon(rings: Sequence[Sequence[Point]], rect: Rect) -> list[list[list[Point]]]:
    """Polygons (outer, holes ...) of a polygon with holes inside a rectangle, exactly: rings are cut where they cross the border, and the pieces are joined along the border, inside kept to the left."""
    x0, y0, x1, y1 = rect
    pieces: list[list[Point]] = []
    closed: list[list[Point]] = []
    corners_in = False
    for number, ring in enumerate(rings):
        ring = [p for k, p in enumerate(ring) if p != ring[k - 1]]
        if len(ring) < 3:
            continue
        if (area(ring) > 0) != (number == 0):
            ring.reverse()
        flat = clip_to_band(clip_to_band(ring, 0, x0, x1), 1, y0, y1)
        if not flat or abs(area(flat)) < 1e-12 * (x1 - x0) * (y1 - y0):
            continue
        # Walk the simple clip: runs along the border are cut out, the rest are pieces inside.
        n = len(flat)
        border = [a[0] == b[0] in (x0, x1) or a[1] == b[1] in (y0, y1) for a, b in zip(flat, [*flat[1:], *flat[:1]], strict=True)]
        if not any(border):
            closed.append(flat)
            continue
        if all(border):
            if number == 0 or area(flat) < 0:
                corners_in = corners_in or number == 0
                if number:  # a hole over the whole rectangle
                    return []
            continue
        start = next(k for k in range(n) if border[k - 1] and not border[k])
        piece = [flat[start]]
        for j in range(n):
            k = (start + j) % n
            if border[k]:
                if len(piece) > 1:
                    pieces.append(piece)
                piece = [flat[(k + 1) % n]]
            else:
                piece.append(flat[(k + 1) % n])
        if len(piece) > 1:
            pieces.append(piece)
    corner = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    total = 2 * (x1 - x0 + y1 - y0)
    outers = [[*corner]] if corners_in and not pieces else []
    at_corner = [(_around(c, rect), c) for c in corner]
    starts = sorted((_around(p[0], rect), k) for k, p in enumerate(pieces))
    used = [False] * len(pieces)
    for first in range(len(pieces)):
        if used[first]:
            continue
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring += pieces[k]
            end = _around(pieces[k][-1], rect)
            ahead = min(starts, key=lambda s: ((s[0] - end) % total, s[1] != k))
            reach = (ahead[0] - end) % total
            ring += [c for _, c in sorted(((a - end) % total, c) for a, c in at_corner) if 0 < (_around(c, rect) - end) % total < reach]
            k = ahead[1]
        ring = [p for j, p in enumerate(ring) if p != ring[j - 1]]
        if len(ring) >= 3:
            outers.append(ring)
    outers += [r for r in closed if area(r) > 0]
    holes = [r for r in closed if area(r) < 0]
    if len(outers) == 1:
        return [[outers[0], *holes]]
    return [[*p] for p in assign_holes(outers, holes)]


def canonical(ring: Sequence[Point]) -> list[Point]:
    k = min(range(len(ring)), key=lambda j: ring[j])
    return [*ring[k:], *ring[:k]]


def tile_polygon(rings: Sequence[Sequence[Point]], extent: int, least_area: float = 0.0) -> list[tuple[tuple[int, int], list[list[tuple[int, int]]], list[list[bool]]]]:
    """((tx, ty), rings, clip flags) for each tile that a polygon in tile units meets: cut to columns, columns to tiles, and each tile exactly. Pieces whose box is under least_area go."""
    out = []
    for tx, column in slabs(rings, 0, *_span(rings[0], 0)):
        for ty, part in slabs(column, 1, *_span(column[0], 1)):
            for polygon in clip_polygon(part, (tx, ty, tx + 1, ty + 1)):
                local = _quantized(polygon, tx, ty, extent)
                if local:
                    xs, ys = zip(*local[0], strict=True)
                    if (max(xs) - min(xs)) * (max(ys) - min(ys)) >= least_area:
                        out.append(((tx, ty), local, [[p[0] in (0, extent) or p[1] in (0, extent) for p in q] for q in local]))
    return out


def _span(ring: Sequence[Point], axis: int) -> tuple[int, int]:
    values = [p[axis] for p in ring]
    return math.floor(min(values)), math.floor(max(values))


def _quantized(polygon: Sequence[Sequence[Point]], tx: int, ty: int, extent: int) -> list[list[tuple[int, int]]]:
    """A polygon of a tile in its units, without rings that have no area there; nothing if that is its outer ring."""
    local = lambda v, t: min(max(round((v - t) * extent), 0), extent)
    rings = [[(local(x, tx), local(y, ty)) for x, y in ring] for ring in polygon]
    rings = [[p for k, p in enumerate(ring) if p != ring[k - 1]] for ring in rings]
    kept = [len(ring) >= 3 and area(ring) != 0 for ring in rings]
    return [canonical(ring) for ring, keep in zip(rings, kept, strict=True) if keep] if kept and kept[0] else []


def union(polygons: Sequence[Sequence[Sequence[Point]]]) -> list[list[list[Point]]]:
    """Union of polygons with holes: the plane is cut into slabs at all vertices and crossings; each slab's covered stretches are traced into rings."""
    edges = [(a, b, k) for k, rings in enumerate(polygons) for ring in rings for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True) if a[1] != b[1]]
    edges = [(a, b, k) if a[1] < b[1] else (b, a, k) for a, b, k in edges]
    ys = {p[1] for a, b, _ in edges for p in (a, b)}
    for i, (a, b, _) in enumerate(edges):
        for c, d, _ in edges[:i]:
            if max(a[1], c[1]) < min(b[1], d[1]) and (den := (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])):
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                y = a[1] + (b[1] - a[1]) * t
                if max(a[1], c[1]) < y < min(b[1], d[1]):
                    ys.add(y)
    levels = sorted(ys)
    x_at = lambda e, y: e[0][0] if y == e[0][1] else e[1][0] if y == e[1][1] else e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
    sides: dict[Point, list[Point]] = defaultdict(list)  # directed, inside to the left
    flats: dict[float, list[tuple[float, int]]] = defaultdict(list)
    for y0, y1 in zip(levels, levels[1:], strict=False):
        mid = (y0 + y1) / 2
        here = sorted((e for e in edges if e[0][1] <= y0 and e[1][1] >= y1), key=lambda e: (x_at(e, mid), x_at(e, y0)))
        within: set[int] = set()
        for _, together in groupby(here, key=lambda e: x_at(e, mid)):  # edges that lie on one another act at once
            was, same = bool(within), list(together)
            for e in same:
                within ^= {e[2]}
            if bool(within) != was:
                low, high = (x_at(same[0], y0), y0), (x_at(same[0], y1), y1)
                (sides[high].append(low) if within else sides[low].append(high))
                flats[y0].append((low[0], 1 if within else -1))
                flats[y1].append((high[0], -1 if within else 1))
    for y, marks in flats.items():  # stretches of a level with the inside on one side only
        depth = 0
        ordered = sorted(marks)
        for (x, d), (after, _) in zip(ordered, ordered[1:], strict=False):
            depth += d
            if depth and x != after:
                (sides[x, y].append((after, y)) if depth > 0 else sides[after, y].append((x, y)))
    rings = []
    while sides:
        start = min(sides)
        ring, p, came = [], start, None
        while True:
            options = sides[p]
            q = options[0] if len(options) == 1 or came is None else min(options, key=lambda o: (math.atan2(came[1] - p[1], came[0] - p[0]) - math.atan2(o[1] - p[1], o[0] - p[0])) % (2 * math.pi) or 9.0)
            options.remove(q)
            if not options:
                del sides[p]
            ring.append(p)
            came, p = p, q
            if p == start:
                break
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (c[0] - b[0]) * (b[1] - a[1])
        size = max(abs(v) for v in (*map(max, ring), *map(min, ring))) or 1.0
        ring = [b for k, b in enumerate(ring) if abs(b[0] - ring[k - 1][0]) + abs(b[1] - ring[k - 1][1]) > 1e-10 * size]
        ring = [b for k, b in enumerate(ring) if abs(cross(ring[k - 1], b, ring[(k + 1) % len(ring)])) > 1e-12 * size * size]
        if len(ring) >= 3:
            rings.append(ring)
    outers, holes = [r for r in rings if area(r) > 0], [r for r in rings if area(r) < 0]
    out: list[list[list[Point]]] = [[o] for o in outers]
    for h in holes:
        probe = ((h[0][0] + h[1][0]) / 2, (h[0][1] + h[1][1]) / 2)
        fits = [k for k, o in enumerate(outers) if inside(probe, o)]
        if fits:
            out[min(fits, key=lambda k: area(outers[k]))].append(h)
    return out


def interior_point(rings: Sequence[Sequence[Point]]) -> Point:
    """Middle of the longest stretch inside on the level half way up; the mean of the vertices if there is none."""
    ys = sorted({p[1] for p in rings[0]})
    mid = (ys[0] + ys[-1]) / 2
    level = mid + (ys[-1] - ys[0]) * 1e-6 if mid in {p[1] for r in rings for p in r} else mid
    xs = sorted(a[0] + (b[0] - a[0]) * (level - a[1]) / (b[1] - a[1]) for r in rings for a, b in zip(r, [*r[1:], *r[:1]], strict=True) if (a[1] > level) != (b[1] > level))
    spans = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2], strict=False)]
    return (max(spans)[1], level) if spans else (sum(p[0] for p in rings[0]) / len(rings[0]), sum(p[1] for p in rings[0]) / len(rings[0]))


def fill_spans(ring: Sequence[Point]) -> list[tuple[int, int, int]]:
    """(y, first x, last x) of the pixels whose centre is inside, by the even-odd rule."""
    out = []
    ys = [p[1] for p in ring]
    for y in range(math.ceil(min(ys) - 0.5), math.floor(max(ys) - 0.5) + 1):
        c = y + 0.5
        xs = sorted(a[0] + (b[0] - a[0]) * (c - a[1]) / (b[1] - a[1]) for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True) if (a[1] <= c) != (b[1] <= c))
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            if (x0 := math.ceil(a - 0.5)) <= (x1 := math.floor(b - 0.5)):
                out.append((y, x0, x1))
    return out


def close_mask(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation then erosion by a square; the outside is empty for the first and full for the second."""
    if radius <= 0:
        return mask

    def spread(m: np.ndarray, axis: int) -> np.ndarray:
        out = m.copy()
        for d in range(1, radius + 1):
            ahead, back = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], back[axis] = slice(d, None), slice(None, -d)
            out[tuple(ahead)] |= m[tuple(back)]
            out[tuple(back)] |= m[tuple(ahead)]
        return out

    wide = spread(spread(mask, 0), 1)
    return ~spread(spread(~wide, 0), 1)


def contours(mask: np.ndarray) -> list[list[Point]]:
    """Outlines of the set pixels' groups at the level half way between set and unset centres: outer ones only."""
    m = np.pad(mask.astype(bool), 1)
    sides: dict[Point, list[Point]] = defaultdict(list)
    code = m[:-1, :-1] * 1 + m[:-1, 1:] * 2 + m[1:, 1:] * 4 + m[1:, :-1] * 8
    top, right, bottom, left = (0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5)
    table = {1: [(top, left)], 2: [(right, top)], 3: [(right, left)], 4: [(bottom, right)], 5: [(top, left), (bottom, right)], 6: [(bottom, top)], 7: [(bottom, left)], 8: [(left, bottom)], 9: [(top, bottom)], 10: [(right, top), (left, bottom)], 11: [(right, bottom)], 12: [(left, right)], 13: [(top, right)], 14: [(left, top)]}
    for y, x in np.argwhere((code > 0) & (code < 15)).tolist():
        for a, b in table[int(code[y, x])]:
            sides[x + a[0] - 0.5, y + a[1] - 0.5].append((x + b[0] - 0.5, y + b[1] - 0.5))
    rings = []
    while sides:
        start = min(sides)
        ring, p = [], start
        while True:
            q = sides[p].pop()
            if not sides[p]:
                del sides[p]
            ring.append(p)
            p = q
            if p == start:
                break
        rings.append(ring)
    return [r for r in rings if area(r) > 0]
