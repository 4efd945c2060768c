"""Numbers in groups of seven bits, zig-zag codes and bit masks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def write_uvarint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_uvarint(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """The number at `at` and the place after it; None if the data end within it or it is longer than 64 bits."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        b = data[at + k]
        value |= (b & 127) << 7 * k
        if b < 128:
            return (value, at + k + 1) if value < 1 << 64 else None
    return None


def write_all(values: Iterable[int]) -> bytes:
    return b"".join(map(write_uvarint, values))


def read_all(data: bytes) -> np.ndarray:
    """Every number of the data, worked out for all at once (UINT64)."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("the data end within a number")
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() > 9:
        raise ValueError("a number is longer than 64 bits")
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def unzigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def zigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def pack_bits(flags: Iterable[bool]) -> bytes:
    return np.packbits(np.array([*flags], bool), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int) -> list[bool]:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool).tolist()
