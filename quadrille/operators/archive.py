"""Tile archives as tables: content dedup, clustered layout, run-length directory, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import running_sum, runs


def contents(tiles: DataFrame, tile_id: str = "tile_id", data: str = "data") -> DataFrame:
    """content (md5 of the bytes), first_id, length, tiles: each distinct content once, with the smallest tile that has it. Partial sums meet, not tiles."""
    return tiles.groupBy(F.md5(data).alias("content")).agg(F.min(tile_id).alias("first_id"), F.first(F.octet_length(data)).cast("bigint").alias("length"), F.count("*").alias("tiles"))


def layout(distinct: DataFrame) -> DataFrame:
    """distinct with offset: contents stand one after the other in order of their first tile."""
    return running_sum(distinct, F.col("length"), "first_id", "offset")


def directory(tiles: DataFrame, placed: DataFrame, tile_id: str = "tile_id", data: str = "data") -> DataFrame:
    """tile_id, offset, length, run_length: consecutive tiles with one content are one entry."""
    at = tiles.select(F.col(tile_id).alias("tile_id"), F.md5(data).alias("content")).join(placed.select("content", "offset", "length"), "content")
    found = runs(at, "offset", "tile_id").withColumnRenamed("first", "tile_id").withColumnRenamed("n", "run_length")
    return found.join(placed.select("offset", "length"), "offset").select("tile_id", "offset", "length", "run_length")


def directory_columns(entries: DataFrame, leaf: Column) -> DataFrame:
    """A leaf's columns as they are stored: differences of tile ids, and offsets as 0 where they follow the entry before, else offset + 1."""
    w = Window.partitionBy("leaf").orderBy("tile_id")
    follows = F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset")
    return entries.withColumn("leaf", leaf).select("leaf", "tile_id", (F.col("tile_id") - F.lag("tile_id", 1, 0).over(w)).alias("d_id"), "run_length", "length", F.when(follows, 0).otherwise(F.col("offset") + 1).alias("offset_code"))


def stats(entries: DataFrame) -> DataFrame:
    """addressed, entries, contents."""
    return entries.agg(F.sum("run_length").alias("addressed"), F.count("*").alias("entries"), F.count_distinct("offset").alias("contents"))


def find(requests: DataFrame, entries: DataFrame, request: str = "q", block: int = 256) -> DataFrame:
    """requests with the entry whose run holds `request`; null columns if none does.

    The range join becomes an equality join: entries are listed in each block of ids that their run meets."""
    parts = entries.select("tile_id", "offset", "length", "run_length", F.explode(F.sequence(F.floor(F.col("tile_id") / block), F.floor((F.col("tile_id") + F.col("run_length") - 1) / block))).alias("__block"))
    asked = requests.withColumn("__block", F.floor(F.col(request) / block))
    inside = (F.col("a.__block") == F.col("e.__block")) & (F.col(request) >= F.col("tile_id")) & (F.col(request) < F.col("tile_id") + F.col("run_length"))
    return asked.alias("a").join(parts.alias("e"), inside, "left").drop("__block")


def nearest_level(zoom: Column, levels: list[int]) -> Column:
    """The level nearest to a zoom, of two the coarser."""
    best = F.array(*(F.struct(F.abs(F.lit(z) - zoom).alias("d"), F.lit(z).alias("z")) for z in levels))
    return F.array_min(best)["z"]


def nearest_ancestor(asked: DataFrame, cached: DataFrame, deepest: int) -> DataFrame:
    """asked (request, z, x, y) with from_z, from_x, from_y: the tile itself, or the nearest ancestor in `cached` where z is beyond `deepest`."""
    up = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("z") > deepest, F.col("z")).otherwise(0))))
    up = up.select("request", "z", "x", "y", (F.col("z") - F.col("k")).alias("from_z"), F.expr("shiftright(x, k)").alias("from_x"), F.expr("shiftright(y, k)").alias("from_y"))
    hit = up.join(cached.select(F.col("z").alias("from_z"), F.col("x").alias("from_x"), F.col("y").alias("from_y")).distinct(), ["from_z", "from_x", "from_y"])
    return hit.groupBy("request", "z", "x", "y").agg(F.max_by(F.struct("from_z", "from_x", "from_y"), "from_z").alias("s")).select("request", "z", "x", "y", "s.*")
