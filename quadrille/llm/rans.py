"""Operator 2, token-id files by a static range asymmetric numeral system.

One frequency table over all ids of the corpus is shared by every file. A file holds one shard: the documents of a range of
doc_id, in ascending order. Its ids are cut into blocks, and each block is coded on its own by interleaved coders (lanes)
that work in step, so that numpy codes a whole row of lanes at once. A block has its lanes' first states, further states
every `every` rows (checkpoints, from which a reader can start), and checksums of its bytes and of its ids. Files are
written by the tasks themselves under names that no other attempt uses; only those that the manifest names are read.

File: MAGIC, table checksum u32 | blocks | footer (zstd): doc ids, their null flags, lengths, block offsets, first ids |
footer length u64, footer checksum u32, MAGIC. All integers are little-endian.

Cases: null texts are empty documents with their end id alone; a null doc_id sorts first; repeated rows are kept, in order
of their ids' bytes; an empty table gives an empty manifest and no rows; other columns are ignored."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, parts_for, staged

MAGIC = b"TOKRANS1"
BITS = 20  # the frequencies of a table add up to 2^BITS
LOW = np.uint64(1 << 31)  # states are in [2^31, 2^63)
HEAD = struct.Struct("<8sI")
TAIL = struct.Struct("<QI8s")
BLOCK = struct.Struct("<IIIIIII")  # ids, lanes, rows between checkpoints, checkpoints, words, checksum of the rest, of the ids
#: Ids a block and lanes of a block at most; rows between two checkpoints; ids a shard at least (if there are that many) and at most, in the mean.
BLOCK_IDS, LANES, EVERY, SHARD_IDS = 1 << 20, 4096, 128, (4_000_000, 128_000_000)


@dataclass(frozen=True)
class Table:
    """ids ascending, and how many of 2^BITS slots each has (1 at least)."""

    ids: np.ndarray
    freq: np.ndarray

    @staticmethod
    def of(counts: dict[int, int]) -> Table:
        ids = np.array(sorted(counts), np.uint32)
        if len(ids) > 1 << (BITS - 1):
            raise ValueError(f"{len(ids)} distinct ids; a table holds {1 << (BITS - 1)}")
        n = np.array([counts[int(i)] for i in ids], np.float64)
        room = (1 << BITS) - len(ids)
        freq = np.ones(len(ids), np.int64)
        if len(ids):
            share = n / n.sum() * room
            freq += np.floor(share).astype(np.int64)
            rest = (1 << BITS) - int(freq.sum())
            freq[np.argsort(np.floor(share) - share, kind="stable")[:rest]] += 1
        return Table(ids, freq.astype(np.uint64))

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", BITS, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def parse(data: bytes) -> Table:
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        bits, n = struct.unpack_from("<II", data)
        if bits != BITS:
            raise ValueError(f"a table of {bits} bits")
        return Table(np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n).astype(np.uint64))

    @cached_property
    def symbols(self) -> np.ndarray:
        """Place in the table of each id that it has."""
        out = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int32)
        out[self.ids] = np.arange(len(self.ids))
        return out

    @cached_property
    def first(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1].astype(np.uint64)]) if len(self.freq) else self.freq


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """ids (at least one) as a block; id k belongs to lane k % lanes, row k // lanes."""
    symbol = table.symbols[ids]
    freq, first = table.freq[symbol], table.first[symbol]
    lanes = max(1, min(LANES, len(ids) // 64))
    rows = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # of the rows from the last to the first
    marks: list[tuple[int, np.ndarray]] = []  # row, states of a reader before it
    shift, bits = np.uint64(32), np.uint64(BITS)
    for row in range(rows - 1, -1, -1):
        a, b = row * lanes, min((row + 1) * lanes, len(ids))
        f, part = freq[a:b], x[: b - a]
        full = part >= (f << np.uint64(63 - BITS))
        words.append((part[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        part = np.where(full, part >> shift, part)
        quotient = part // f
        x[: b - a] = (quotient << bits) + (part - quotient * f) + first[a:b]
        if row % EVERY == 0:
            marks.append((row, x.copy()))
    words.reverse()
    before = np.cumsum([0, *map(len, words)])
    body = b"".join(struct.pack("<II", row, before[row]) + states.astype("<u8").tobytes() for row, states in reversed(marks))
    body += b"".join(w.tobytes() for w in words)
    return BLOCK.pack(len(ids), lanes, EVERY, len(marks), int(before[-1]), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


class Decoder:
    def __init__(self, table: Table) -> None:
        self.symbol = np.repeat(np.arange(len(table.ids)), table.freq.astype(np.int64)).astype(np.uint32)
        self.table, self.first = table, table.first

    def block(self, data: bytes, at: int = 0, *, mark: int = 0, rows: int | None = None) -> np.ndarray:
        """The ids of the block at `at`; from checkpoint `mark` on, and so many rows, if told. A whole block's checksums are compared."""
        n, lanes, _, marks, n_words, crc, ids_crc = BLOCK.unpack_from(data, at)
        at += BLOCK.size
        size = 8 + 8 * lanes
        whole = mark == 0 and rows is None
        if whole and zlib.crc32(memoryview(data)[at : at + size * marks + 4 * n_words]) != crc:
            raise ValueError("a block is damaged")
        row, ptr = struct.unpack_from("<II", data, at + size * mark)
        x = np.frombuffer(data, "<u8", lanes, at + size * mark + 8).copy()
        words = np.frombuffer(data, "<u4", n_words, at + size * marks)
        last = -(-n // lanes) if rows is None else min(-(-n // lanes), row + rows)
        out = np.empty(min(n, last * lanes) - row * lanes, np.uint32)
        freq, first, mask, bits, shift = self.table.freq, self.first, np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        to = 0
        for r in range(row, last):
            k = min(lanes, n - r * lanes)
            part = x[:k]
            slot = part & mask
            s = self.symbol[slot]
            part = freq[s] * (part >> bits) + slot - first[s]
            low = np.flatnonzero(part < LOW)
            part[low] = (part[low] << shift) | words[ptr : ptr + len(low)]
            ptr += len(low)
            x[:k] = part
            out[to : to + k] = s
            to += k
        ids = self.table.ids[out]
        if whole and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("a block's ids are damaged")
        return ids


class ShardWriter:
    """Documents, in order, into the bytes of one file, block by block."""

    def __init__(self, out: Any, table: Table) -> None:
        self.out, self.table = out, table
        self.at = 0
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, int]] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.total = 0
        self._put(HEAD.pack(MAGIC, zlib.crc32(table.to_bytes())))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        while len(ids):
            part = ids[: BLOCK_IDS - self.waiting]
            self.open.append(part)
            self.waiting += len(part)
            ids = ids[len(part) :]
            if self.waiting == BLOCK_IDS:
                self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.blocks.append((self.at, self.total))
            self._put(encode_block(np.concatenate(self.open), self.table))
            self.total += self.waiting
            self.open, self.waiting = [], 0

    def close(self) -> None:
        import zstandard

        self._flush()
        parts = [np.array(self.ids, "<i8"), np.packbits(np.array(self.nulls, bool), bitorder="little"), np.array(self.lengths, "<u8"), np.array(self.blocks, "<u8").reshape(-1, 2)]
        footer = zstandard.compress(struct.pack("<QQ", len(self.ids), len(self.blocks)) + b"".join(p.tobytes() for p in parts))
        self._put(footer)
        self._put(TAIL.pack(len(footer), zlib.crc32(footer), MAGIC))


@dataclass(frozen=True)
class Index:
    ids: list[int | None]
    lengths: np.ndarray
    blocks: np.ndarray  # offset, first id


def read_index(file: Any, size: int, table: Table) -> Index:
    """What a file says of its documents and blocks. file: seek() and read()."""
    import zstandard

    magic, crc = HEAD.unpack(file.read(HEAD.size))
    file.seek(size - TAIL.size)
    length, footer_crc, end = TAIL.unpack(file.read(TAIL.size))
    if magic != MAGIC or end != MAGIC or crc != zlib.crc32(table.to_bytes()):
        raise ValueError("not a file of this format, or of another table")
    file.seek(size - TAIL.size - length)
    footer = file.read(length)
    if zlib.crc32(footer) != footer_crc:
        raise ValueError("a footer is damaged")
    data = zstandard.decompress(footer)
    n, blocks = struct.unpack_from("<QQ", data)
    at = 16
    ids = np.frombuffer(data, "<i8", n, at).tolist()
    flags = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8 * n), bitorder="little")[:n]
    at += 8 * n + -(-n // 8)
    return Index([None if f else i for i, f in zip(ids, flags, strict=True)], np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u8", 2 * blocks, at + 8 * n).reshape(-1, 2).astype(np.int64))


def read_documents(file: Any, size: int, table: Table) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Each document of a file, its ids in parts as the blocks have them; one block is in memory at a time."""
    index, decoder = read_index(file, size, table), Decoder(table)
    ends = [*index.blocks[1:, 0].tolist(), size]
    k, here = 0, np.empty(0, np.uint32)
    for doc_id, length in zip(index.ids, index.lengths.tolist(), strict=True):
        parts = []
        while length:
            if not len(here):
                start = int(index.blocks[k, 0])
                file.seek(start)
                here, k = decoder.block(file.read(ends[k] - start)), k + 1
            parts.append(here[:length])
            here, length = here[len(parts[-1]) :], length - len(parts[-1])
        yield doc_id, parts


def _files(uri: str) -> tuple[Any, str]:
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@cache
def _zstd() -> tuple[Any, Any]:
    """A compressor and a decompressor for this process: making one costs more than a document."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(ids: bytes) -> bytes:
    """32-bit ids for the way between stages: 16 bits each where that is enough, and compressed; the first byte tells which."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + _zstd()[0].compress(wide.astype("<u2").tobytes() if narrow else ids)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(memoryview(data)[1:]), "<u2" if data[0] == 2 else "<u4")


def count_ids(tokens: DataFrame, ids: str = "ids") -> dict[int, int]:
    """How often each id occurs in all rows; the driver gets a row for each id of the vocabulary at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                here = np.bincount(np.concatenate([unsqueezed(x) for x in batch.column(0).slice(at, 500).to_pylist()]), minlength=len(total))
                here[: len(total)] += total
                total = here
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return {r[0]: r[1] for r in tokens.select(ids).mapInArrow(count, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n")).collect()}


MANIFEST = "path STRING, documents BIGINT, n_ids BIGINT, bytes BIGINT, first_doc BIGINT, first_null BOOLEAN"


def write_files(tokens: DataFrame, folder: str, *, doc_id: str = "doc_id", ids: str = "ids", shard_ids: tuple[int, int] = SHARD_IDS) -> DataFrame:
    """tokens (a table that reads the same twice, its ids squeezed) as a shared table file and shard files in `folder`. Returns the manifest, in which each row names a file; shards are ranges of doc_id, and of the ids where many rows have one doc_id or none."""
    counts = count_ids(tokens, ids)
    table = Table.of(counts)
    where, base = _files(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/table") as f:
        f.write(table.to_bytes())
    packed = table.to_bytes()  # at most 8 bytes for each id of the vocabulary

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _files(folder)
        name = f"shard-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"  # names sort as the ranges do
        out = writer = None
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    out = fs.open_output_stream(f"{at}/{name}", buffer_size=1 << 20)
                    writer = ShardWriter(out, Table.parse(packed))
                writer.add(doc, unsqueezed(data))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "documents": len(writer.ids), "n_ids": writer.total, "bytes": writer.at, "first_doc": writer.ids[0], "first_null": writer.nulls[0]}])

    shards = parts_for(tokens.sparkSession, sum(counts.values()), *shard_ids)
    rows = tokens.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).repartitionByRange(shards, "doc_id", F.substring("ids", 1, 32)).sortWithinPartitions("doc_id", "ids")
    return staged(rows.mapInArrow(write, MANIFEST), "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files, each task one file at a time."""
    order = Window.orderBy("path")  # a row for each file
    shards = manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids")).select("path", "bytes", "before")
    tasks = max(1, manifest.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib as z

        fs, at = _files(folder)
        with fs.open_input_stream(f"{at}/table") as f:
            table = Table.parse(f.read())
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with fs.open_input_file(_files(path)[1]) as f:
                    for doc, parts in read_documents(f, size, table):
                        n, crc = 0, 0
                        for p in parts:
                            n, crc = n + len(p), z.crc32(p.astype("<u4").tobytes(), crc)
                        rows.append((doc, start, n, crc))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(tasks, "path").mapInArrow(read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def token_files(docs: DataFrame, *, path: str, folder: str | None = None, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", shard_ids: tuple[int, int] = SHARD_IDS) -> tuple[str, DataFrame]:
    """Tokenizes whole documents once and writes them; returns the folder and the manifest."""
    from .tokens import token_ids

    tokens = staged(token_ids(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text), text, path=path, end_id=end_id, form=squeezed), "ids", codec="uncompressed")
    folder = folder or new_path(docs.sparkSession, "tokens")
    return folder, write_files(tokens, folder, shard_ids=shard_ids)
