"""Ordered-sequence operators: running numbers by blocks, runs, layout, interval coalescing, deltas, change gates.

Whatever runs over a whole table goes in two levels, sums of blocks and then rows within a block, so that no task sorts the
table: the window over blocks alone is unpartitioned, with one row for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consecutive ids in a block.
BLOCK = 1 << 16


def running_sum(df: DataFrame, value: Column, order: str, out: str, block: int = BLOCK) -> DataFrame:
    """out: the sum of `value` over rows with a smaller `order` (a unique integer)."""
    dealt = df.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__value", value)
    sums = dealt.groupBy("__block").agg(F.sum("__value").alias("__sum"))
    sums = sums.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__ahead"))
    within = F.sum("__value").over(Window.partitionBy("__block").orderBy(order)) - F.col("__value")
    return dealt.withColumn(out, within).join(sums, "__block").withColumn(out, F.col(out) + F.col("__ahead")).drop("__block", "__value", "__ahead")


def dense_ids(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Rank from 0 of each distinct id, as of a bit set with counts of its blocks."""
    return running_sum(ids.select(column).distinct(), F.lit(1).cast("bigint"), column, out)


def runs(df: DataFrame, key: str, position: str, block: int = BLOCK) -> DataFrame:
    """Islands of consecutive positions with one key: key, first, n. Runs are found in blocks of positions, then runs that meet at a border are joined."""
    part = df.select(key, position, F.floor(F.col(position) / block).alias("__block"))
    island = F.col(position) - F.row_number().over(Window.partitionBy(key, "__block").orderBy(position))
    short = part.withColumn("__island", island).groupBy(key, "__block", "__island").agg(F.min(position).alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("first")
    starts = F.when(F.lag(F.col("first") + F.col("n")).over(w) == F.col("first"), 0).otherwise(1)
    joined = short.withColumn("__starts", starts).withColumn("__run", F.sum("__starts").over(w))
    return joined.groupBy(key, "__run").agg(F.min("first").alias("first"), F.sum("n").alias("n")).drop("__run")


def coalesce_ranges(df: DataFrame, group: str, offset: str, length: str, gap: int) -> DataFrame:
    """group, first, size: ranges of a group that overlap or leave a gap of `gap` at most become one."""
    end = F.col(offset) + F.col(length)
    before = Window.partitionBy(group).orderBy(offset, length)
    seen = F.max(end).over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(seen.isNull() | (F.col(offset) > seen + gap), 1).otherwise(0)
    marked = df.withColumn("__starts", starts).withColumn("__run", F.sum("__starts").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "__run").agg(F.min(offset).alias("first"), (F.max(end) - F.min(offset)).alias("size")).drop("__run")


def deltas(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Differences to the row before (0 before the first) as d_<column>."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c, 1, 0).over(w) for c in columns})


def undeltas(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(f"d_{c}").over(w) for c in columns})


def changed(df: DataFrame, session: str, order: list[str], view: list[str]) -> DataFrame:
    """builds: true where a session's view differs from its view before, and for the first."""
    key = F.xxhash64(*view)
    return df.withColumn("builds", ~key.eqNullSafe(F.lag(key).over(Window.partitionBy(session).orderBy(*order))))
