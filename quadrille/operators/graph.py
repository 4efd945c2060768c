"""Connected components by rounds of stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that links reach, for each node with a link.

    A round points each node's larger neighbours, then each node and its smaller ones, at the smallest it knows; partial
    aggregates find that smallest, and what joins it back is a join that Spark splits where a node is hot. Rounds are
    written to the shared folder and end when one changes nothing."""
    low, high = F.least(a, b), F.greatest(a, b)
    now = staged(edges.where(F.col(a) != F.col(b)).select(high.alias("v"), low.alias("u")).distinct(), "links")

    def facts(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())

    before = facts(now)
    while before[0]:
        both = now.select("v", "u").unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        larger = both.select(F.col("v").alias("w"), F.col("u").alias("x")).where("x > w")
        larger = larger.join(least, F.col("w") == F.col("v")).select(F.col("x").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        larger = staged(larger, "large")
        least = larger.groupBy("v").agg(F.min("u").alias("m"))
        small = larger.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("s")).select("s.*")
        now = staged(small.where("v <> u").distinct(), "small")
        after = facts(now)
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("label"))
