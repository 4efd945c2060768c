"""Operator 4, substring deduplication by content-defined chunking.

A gear rolling hash over the UTF-8 bytes sets the cuts, so a passage has the same chunks wherever it stands, from its second
cut on, whatever comes before it. Chunks are grouped by a 64-bit digest (a chance collision is harmless: only runs of several
copies count); the document with the smallest doc_id has the original, the first in its text, and all others are copies. Runs
of neighbouring copies with MIN_WORDS words or more are removed, shorter ones are taken for common phrases and stay.

Only (digest, doc_id, hash of the text) rows are shuffled by digest, each digest of a document once, never texts: the last pass cuts its texts
again and needs no positions. A digest's rows meet in partial sums; the join back is one that Spark splits when a digest is
hot. The copied digests of a text come back as a list bounded by its own length, however many rows share its doc_id or have none.

Cases: null and empty texts have no chunks and come back as they are; rows of one doc_id count as one document and aren't
copies of each other; without a doc_id each different text is a document, after all others, in order of a hash of the text;
equal rows come back equal; an empty table gives no rows; columns of the input other than `text` and
`n_chars` come back untouched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import own, staged

#: Bytes of a chunk: at least, at most; a cut is expected every 2^CUT_BITS bytes.
LEAST, MOST, CUT_BITS = 8, 64, 4
#: Words that a run of copies must have to be removed.
MIN_WORDS = 16
_WINDOW = 32  # bytes that a 32-bit gear hash still knows


def _gears() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


GEAR = _gears()


def gear_cuts(data: bytes) -> np.ndarray:
    """Ends of the places where the gear hash h = 2 h + GEAR[byte] (mod 2^32) has its highest CUT_BITS bits zero."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < _WINDOW:  # the sum of a window of 2 w bytes from two of w bytes
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes: the candidates that leave LEAST bytes, or MOST bytes where none comes."""
    ends, start, n = [], 0, len(data)
    for cut in gear_cuts(data).tolist():
        while cut - start > MOST:
            start += MOST
            ends.append(start)
        if cut - start >= LEAST:
            ends.append(cut)
            start = cut
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[tuple[int, int, int]]:
    """(first byte, end, digest) of each chunk."""
    out, a = [], 0
    for b in chunk_ends(data) if data else ():
        out.append((a, b, xxhash.xxh3_64_intdigest(data[a:b]) - 2**63))
        a = b
    return out


def chunk_rows(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, d (the doc_id), h (a hash of the text): each digest of each text once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [np.fromiter({c[2] for c in chunks_of((t or "").encode("utf-8", "surrogatepass"))}, np.int64) for t in part.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(rows), part.column(2).take(rows)], ["digest", "d", "h"])

    return df.select(F.col(doc_id).cast("bigint").alias("d"), text, F.xxhash64(text).alias("h")).mapInArrow(run, "digest BIGINT, d BIGINT, h BIGINT")


def copies(chunks: DataFrame) -> DataFrame:
    """d, h, digests: of each text the digests that an earlier document has.

    The first join side is written down, so that Spark may split the other one where a digest is hot."""
    first = chunks.groupBy("digest").agg(F.min("d").alias("first"), F.min(F.when(F.col("d").isNull(), F.col("h"))).alias("first_h"), F.count("*").alias("n"))
    again = staged(first.where("n > 1").select("digest", "first", "first_h"), "repeated")
    found = chunks.join(again, "digest").where(F.when(F.col("d").isNull(), F.col("first").isNotNull() | (F.col("h") != F.col("first_h"))).otherwise(F.col("d") != F.col("first")))
    return found.groupBy("d", "h").agg(F.collect_set("digest").alias("digests"))  # of one text: bounded by its length


def runs_to_drop(data: bytes, spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined; those of min_words words or more."""
    out: list[list[int]] = []
    for at, size in spans:
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + size)
        else:
            out.append([at, at + size])
    return [(a, b) for a, b in out if len(data[a:b].split()) >= min_words]


def cut_out(text: str, digests: set[int], min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]]]:
    """The text without its runs of copies (chunks whose digest is in `digests` or stood in the text before), and those runs as code point positions.

    Cuts are moved to code point borders, inwards."""
    data = text.encode("utf-8", "surrogatepass")
    spans, seen = [], set()
    for a, b, digest in chunks_of(data):
        if digest in digests or digest in seen:
            spans.append((a, b - a))
        seen.add(digest)
    drop = runs_to_drop(data, spans, min_words)
    kept, gone, at, chars = [], [], 0, 0
    for a, b in drop:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        head, body = data[at:a].decode("utf-8", "surrogatepass"), data[a:b].decode("utf-8", "surrogatepass")
        kept.append(head)
        chars += len(head)
        gone.append((chars, chars + len(body)))
        chars += len(body)
        at = b
    kept.append(data[at:].decode("utf-8", "surrogatepass"))
    return "".join(kept), gone


def deduplicate(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with `text` without its copied passages, n_chars (its code points) and removed: the passages' places in the old text (array of first, end)."""
    digests_name, key, key_h = own("digests", "key", "h")
    found = staged(copies(chunk_rows(df, doc_id=doc_id, text=text)), "copies").select(F.col("d").alias(key), F.col("h").alias(key_h), F.col("digests").alias(digests_name))
    joined = df.drop("removed").join(found, F.col(doc_id).cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(key_h)), "left").drop(key, key_h)
    kept = [c for c in df.columns if c not in ("removed", "n_chars")]
    out = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_chars", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    arrow = to_arrow_schema(out)
    k = kept.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for t, digests in zip(batch.column(k).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                new, places = (t, []) if t is None else cut_out(t, set(digests or ()), min_words)
                texts.append(new)
                gone.append([{"first": a, "end": b} for a, b in places])
            columns = [batch.column(j) for j in range(len(kept))]
            columns[k] = pa.array(texts, arrow.field(k).type)
            lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(j).type) for j, c in enumerate(columns)), lengths, pa.array(gone, arrow.field(len(kept) + 1).type)], schema=arrow)

    done = joined.select(*kept, digests_name).mapInArrow(run, out)
    order = [c for c in df.columns if c != "removed"]
    return done.select(*order, *([] if "n_chars" in order else ["n_chars"]), "removed")
