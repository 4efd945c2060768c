"""Operator 8, canonical exact digests.

A text's canonical form is its Unicode compatibility form (NFKC), case-folded, white space runs as one blank, trimmed; two
texts that differ in these only are the same text. The digest is the 128-bit xxh3 of the canonical form's UTF-8 bytes.
Documents with equal digests are then grouped by the canonical bytes themselves, so that a collision of digests can't join
two texts: the second and later texts of a digest, in order of their bytes, get a suffix -1, -2 and so on. Only texts whose
digest occurs twice are moved for that, and equal texts meet in partial sums, so no task gathers a group.

Cases: null is the empty text; an empty table gives no rows; repeated rows stay; other columns are ignored."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import parts_for, staged

#: Rows that a range of neighbours holds at least (if there are that many) and at most, in the mean.
RANGE_ROWS = (2000, 50_000)
#: Bits of the map of digests that occur twice.
MAP_BITS = 1 << 27


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    form = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", form).split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def digests(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(canonical(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "digest"])

    return _rows(df, doc_id, text).mapInArrow(run, "doc_id BIGINT, digest STRING")


def _marked(repeated: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits, set at the first 32 bits of each digest: 16 MB, however many there are."""
    at = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % MAP_BITS
    words = repeated.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def same_bytes(df: DataFrame, repeated: DataFrame, *, text: str = "text") -> DataFrame:
    """Of the documents with a digest in `repeated` (a column `digest`), and of some more: digest, canonical form, its number among the digest's forms (0 first).

    Texts are found again by their digest, whatever their doc_id; a map of bits keeps nearly all others from being moved."""
    marks = _marked(repeated)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                form = canonical(t)
                d = digest(form)
                at = int(d[:8], 16) % MAP_BITS
                if int(marks[at >> 6]) >> (at & 63) & 1:
                    rows.append((d, form))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["digest", "form"])

    forms = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "digest STRING, form STRING")
    forms = forms.groupBy("digest", "form").agg(F.count("*").alias("rows"))  # compares the bytes
    return forms.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy(F.encode("form", "UTF-8"))) - 1)


def fingerprint_groups(df: DataFrame, found: DataFrame, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """found: doc_id, digest of every row of df (as digests() gives them, staged).

    Returns the groups (digest, n documents, smallest doc_id) and the collisions: canonical forms that aren't the first of their digest (digest, form, number), of which there are none unless xxh3 collides."""
    groups = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id"))
    groups = staged(groups, "groups")
    collisions = staged(same_bytes(df, groups.where("n > 1"), text=text).where("number > 0").select("digest", "form", "number"), "collisions")
    return groups, collisions


def pair_with_next(df: DataFrame, fields: str, fn: Callable[[str, str], tuple], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fn(text, text of the next document) for each row, in ascending doc_id (null first, ties by text); after the last row the first.

    Texts move once, to ranges of doc_id and, where many rows have one doc_id or none, of the text's first characters. What a range can't decide alone, its last row with the first row of the range
    after it, is kept beside the results: two rows of each range, paired by a join in the end."""
    rows = _rows(df, doc_id, text)
    ranges = parts_for(df.sparkSession, rows.count(), *RANGE_ROWS)
    out = [*T.StructType.fromDDL(fields)]
    inner = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("edge", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), *out])
    arrow = to_arrow_schema(inner)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part = TaskContext.get().partitionId()  # ranges are numbered in their order
        for batch in batches:
            found = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.append((row[0], 0, part, row[1], *[None] * len(out)) if last is None else (last[0], None, None, None, *fn(last[1], row[1])))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow) if found else pa.RecordBatch.from_pylist([], arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((last[0], 1, part, last[1], *[None] * len(out)), arrow, strict=True)], schema=arrow)

    ran = staged(rows.repartitionByRange(ranges, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(run, inner), "pairs")
    edges = ran.where("edge IS NOT NULL")
    firsts = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    lasts = edges.where("edge = 1").select(F.col("doc_id").alias("last_id"), "part", "text")
    order = Window.orderBy("part")  # a number for each range
    follows = edges.where("edge = 0").select("part").withColumns({"next": F.lead("part").over(order), "least": F.min("part").over(Window.partitionBy())})
    ends = lasts.join(follows.select("part", F.coalesce("next", "least").alias("next")), "part").join(firsts, "next")

    def run_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.schema([arrow.field(0), *list(arrow)[4:]])
        for batch in batches:
            found = [(d, *fn(a, b)) for d, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kept, strict=True)], schema=kept)

    ended = ends.select("last_id", "text", "next_text").mapInArrow(run_ends, T.StructType([inner[0], *out]))
    return ran.where("edge IS NULL").drop("edge", "part", "text").unionByName(ended)


CONTRACT = "n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"


def edited(text: str, after: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document its fingerprint, that of its edited text, and whether they and the next document's are the same text (1 or 0)."""
    found = staged(digests(df, doc_id=doc_id, text=text), "digests")
    groups, collisions = fingerprint_groups(df, found, text=text)
    numbers = {(r.digest, r.form): f"-{r.number}" for r in collisions.limit(10_000).collect()}  # empty unless a 128-bit hash collides
    if len(numbers) == 10_000:
        raise ValueError("the hash collides too often")

    def fingerprint(form: str) -> str:
        d = digest(form)
        return d + numbers.get((d, form), "")

    def pair(a: str, b: str) -> tuple:
        new = edited(a, b)
        forms = [canonical(x) for x in (a, new, b)]
        return len(a), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(forms[0]), fingerprint(forms[1]), float(forms[0] == forms[1]), float(forms[0] == forms[2])

    out = pair_with_next(df, CONTRACT, pair, doc_id=doc_id, text=text)
    if numbers:  # groups of colliding digests are told apart by their fingerprints
        return out.withColumn("group_rows", F.lit(None).cast("bigint"))
    return out.join(groups.select(F.col("digest").alias("fingerprint"), F.col("n").alias("group_rows")), "fingerprint", "left").select("doc_id", *(c.split()[0] for c in CONTRACT.split(", ")), "group_rows")
