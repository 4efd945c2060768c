"""Tile numbers: Morton and Hilbert order, build ids, spill buckets; integer expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks that part the bits of a number by 1, 2, 4, 8 places.
_STEPS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(v: Column) -> Column:
    v = v.cast("bigint").bitwiseAND(0xFFFF)
    for places, mask in _STEPS:
        v = v.bitwiseOR(F.shiftleft(v, places)).bitwiseAND(mask)
    return v


def _gather(v: Column) -> Column:
    v = v.cast("bigint").bitwiseAND(0x55555555)
    for (places, _), mask in zip(reversed(_STEPS), (0x33333333, 0x0F0F0F0F, 0x00FF00FF, 0x0000FFFF), strict=True):
        v = v.bitwiseOR(F.shiftright(v, places)).bitwiseAND(mask)
    return v.cast("int")


def morton(x: Column, y: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_x(m: Column) -> Column:
    return _gather(m)


def morton_y(m: Column) -> Column:
    return _gather(F.shiftright(m, 1))


def below(z: Column) -> Column:
    """Tiles of all zooms under z: (4^z - 1) / 3."""
    return ((F.call_function("shiftleft", F.lit(1).cast("bigint"), (2 * z).cast("int")) - 1) / 3).cast("bigint")


def build_id(x: Column, y: Column, z: Column) -> Column:
    return below(z) + morton(x, y)


def zoom_of_id(tile_id: Column, most: int = 16) -> Column:
    """The zoom of a build or archive id."""
    out = F.lit(0)
    for z in range(1, most + 1):
        out = F.when(tile_id >= ((1 << 2 * z) - 1) // 3, z).otherwise(out)
    return out


def bucket(morton_id: Column, z: Column, bucket_zoom: int) -> Column:
    """Prefix of the Morton number at bucket_zoom; coarser tiles go to the first bucket of theirs."""
    down = F.call_function("shiftright", morton_id, F.greatest(2 * (z - bucket_zoom), F.lit(0)).cast("int"))
    up = F.call_function("shiftleft", morton_id, F.greatest(2 * (F.lit(bucket_zoom) - z), F.lit(0)).cast("int"))
    return F.when(z >= bucket_zoom, down).otherwise(up)


def bucket_local_id(x: Column, y: Column, z: Column, bucket_zoom: int) -> Column:
    """The build id of a tile within its bucket's subtree: as if the bucket were the world."""
    lz = (z - bucket_zoom).cast("int")
    within = F.call_function("shiftleft", F.lit(1).cast("bigint"), lz)
    return build_id((x % within).cast("int"), (y % within).cast("int"), lz)


def of_bucket_local(local_id: Column, bucket_: Column, bucket_zoom: int) -> tuple[Column, Column, Column]:
    """x, y, z of a tile from that id and its bucket."""
    lz = zoom_of_id(local_id)
    m, side = local_id - below(lz), F.call_function("shiftleft", F.lit(1), lz.cast("int"))
    return (morton_x(bucket_) * side + morton_x(m)).cast("int"), (morton_y(bucket_) * side + morton_y(m)).cast("int"), (lz + bucket_zoom).cast("int")


def hilbert(x: Column, y: Column, z: Column) -> Column:
    """Place of a tile on the Hilbert curve of its zoom: one step for each bit, from the highest."""
    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(state: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        rx = F.when(state["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("bigint")
        ry = F.when(state["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("bigint")
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - state["x"]).otherwise(state["x"]), F.when(flip, side - 1 - state["y"]).otherwise(state["y"])
        turn = ry == 0
        return F.struct(F.when(turn, fy).otherwise(fx).alias("x"), F.when(turn, fx).otherwise(fy).alias("y"), (state["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d"))

    steps = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)["d"]


def archive_id(x: Column, y: Column, z: Column) -> Column:
    return below(z) + hilbert(x, y, z)


def zigzag16(delta: Column) -> Column:
    return F.shiftleft(delta, 1).bitwiseXOR(F.shiftright(delta, 31)).bitwiseAND(65535)


def unzigzag16(code: Column) -> Column:
    return F.shiftright(code, 1).bitwiseXOR(-code.bitwiseAND(1))


def varint_size(v: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(9)  # of a BIGINT that isn't negative
    for n in range(8, 0, -1):
        out = F.when(v < (1 << 7 * n), n).otherwise(out)
    return out


def hilbert_int(z: int, x: int, y: int) -> int:
    """The same for one tile, for kernels and tests."""
    d = 0
    for k in range(z - 1, -1, -1):
        side = 1 << k
        rx, ry = int(bool(x & side)), int(bool(y & side))
        d += side * side * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return d


def archive_id_int(z: int, x: int, y: int) -> int:
    return ((1 << 2 * z) - 1) // 3 + hilbert_int(z, x & ((1 << z) - 1), y & ((1 << z) - 1))
