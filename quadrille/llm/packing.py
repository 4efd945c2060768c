"""Operator 1, best-fit packing by a plan over the histogram of lengths.

The driver sees counts of lengths only (at most `capacity` of them). It runs best-fit decreasing over the counts: bins of
equal fill are one group, and a length enters groups, not bins. The plan is a short table of slot intervals; documents
find their slot by their rank within their length. Cost on the driver depends on the capacity, not on the documents.

Cases: a null text is empty and packs as its end id alone; an empty table gives no rows; repeated rows each get a slot;
lengths that are null, under 1 or over the capacity get a null place; other columns of the input pass through untouched."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own, staged
from .tokens import REMEMBERED, token_ids

#: Rows that share a rank window at most, in the mean, even if all have one length.
RANK_ROWS = 1000
RANK_BUCKETS = 65_536
#: Rows of the plan that go out as a broadcast: 40 bytes each.
PLAN_BROADCAST = 100_000
SLOTS = "length INT, first_rank BIGINT, end_rank BIGINT, first_bin BIGINT, per_bin INT, at INT"


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slot intervals (length, first rank, end rank, first bin, items a bin, offset) and the number of bins.

    The item of rank r in its interval goes to bin first_bin + (r - first_rank) // per_bin, as item (r - first_rank) % per_bin."""
    slots, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free room: (first bin, bins)
    free: list[int] = []  # rooms with groups, ascending

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                insort(free, room)
            groups[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n and 0 < k <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(free, length)
            if k < len(free):
                room = free[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    free.pop(k)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length  # the fullest bin that fits is the one just used, until no more fits
            whole = min(n, left // each)
            if whole:
                slots.append((length, rank, rank + whole * each, first, each, capacity - room))
                rank, left = rank + whole * each, left - whole * each
                put(room - each * length, first, whole)
            if left and whole < n:  # the rest go to one bin
                slots.append((length, rank, rank + left, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            put(room, first + whole, n - whole)
    return slots, bins


def rank_within(df: DataFrame, group: str, order: list[str], rows: int, out: str) -> DataFrame:
    """Ranks from 0 within each group, without bringing a group together: ranks within hashed buckets plus the buckets' running counts."""
    bucket, before = own("bucket", "before")
    n = max(1, min(RANK_BUCKETS, -(-rows // RANK_ROWS)))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sums = dealt.groupBy(group, bucket).agg(F.count("*").alias(before))
    sums = sums.withColumn(before, F.sum(before).over(Window.partitionBy(group).orderBy(bucket)) - F.col(before))
    rank = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    return dealt.withColumn(out, rank).join(sums, [group, bucket]).withColumn(out, F.col(out) - 1 + F.col(before)).drop(bucket, before)


def pack(df: DataFrame, length: str = "length", *, capacity: int = 1024, order: list[str]) -> DataFrame:
    """df with sequence_id and offset (BIGINT). df must be a table that reads the same twice; order: columns that tell its rows apart.

    Columns of df with those names are replaced."""
    spark = df.sparkSession
    df = df.drop("sequence_id", "offset")
    fits = F.col(length).between(1, capacity)
    counts = {int(r[0]): r[1] for r in df.where(fits).groupBy(F.col(length).cast("int")).count().collect()}  # at most `capacity` rows
    slots, _ = plan_slots(counts, capacity)
    rank, key = own("rank", "key")
    plan = spark.createDataFrame(slots, SLOTS).select(*(F.col(c).alias(f"__slot_{c}") for c in ("length", "first_rank", "end_rank", "first_bin", "per_bin", "at")))
    if len(slots) <= PLAN_BROADCAST:
        plan = F.broadcast(plan)
    ranked = rank_within(df.where(fits).withColumn(key, F.col(length).cast("int")), key, order, sum(counts.values()), rank)
    at = F.col(rank) - F.col("__slot_first_rank")
    placed = ranked.join(plan, (F.col(key) == F.col("__slot_length")) & (F.col(rank) >= F.col("__slot_first_rank")) & (F.col(rank) < F.col("__slot_end_rank")))
    placed = placed.select(*df.columns, (F.col("__slot_first_bin") + F.floor(at / F.col("__slot_per_bin"))).cast("bigint").alias("sequence_id"), (F.col("__slot_at") + at % F.col("__slot_per_bin") * F.col(key)).cast("bigint").alias("offset"))
    none = F.lit(None).cast("bigint")
    return placed.unionByName(df.where(~F.coalesce(fits, F.lit(False))).withColumns({"sequence_id": none, "offset": none}))


def pieces(df: DataFrame, ids: str = "ids", *, capacity: int = 1024) -> DataFrame:
    """One row for each piece of at most `capacity` ids; only the first piece of a longer document may be shorter. Adds piece, start, length and cuts `ids`."""
    total = F.expr(f"octet_length({ids}) div 4").cast("int")
    n, first = own("n", "first")
    cut = df.drop("piece", "start", "length").withColumn(n, total).withColumn(first, F.when(F.col(n) <= capacity, F.col(n)).otherwise((F.col(n) - 1) % capacity + 1))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil((F.col(n) - F.col(first)) / capacity).cast("int"))))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col(first) + (F.col("piece") - 1) * capacity)
    length = F.when(F.col("piece") == 0, F.col(first)).otherwise(capacity)
    cut = cut.withColumn("start", start.cast("bigint")).withColumn("length", length.cast("bigint"))
    return cut.withColumn(ids, F.expr(f"substring({ids}, int(start * 4 + 1), int(length * 4))")).drop(n, first)


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, in order of offset. A group holds `capacity` ids at most."""
    parts: Column = F.array_sort(F.collect_list(F.struct("offset", F.hex(ids).alias("h"))))
    return placed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("ids"))


def pack_documents(docs: DataFrame, *, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", remembered: int = REMEMBERED) -> DataFrame:
    """Tokenizes, cuts and packs whole documents; ids_crc32 stands for the ids, which the caller can have from pieces()."""
    cut = pieces(token_ids(docs, text, path=path, end_id=end_id, keys=(doc_id,), remembered=remembered), capacity=capacity)
    (row,) = own("row")  # tells equal rows apart, so that many of them share no window
    slim = staged(cut.select(doc_id, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias(row)), "pieces")
    return pack(slim, capacity=capacity, order=[doc_id, "piece", "ids_crc32", row]).drop(row)


