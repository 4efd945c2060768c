"""Nodes, ways and relations made from the star-schema tables, so that SQL on those tables can check each relational operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import mercator_x, mercator_y

#: Highway value of each order priority.
PRIORITY = {"1-URGENT": "motorway", "2-HIGH": "trunk", "3-MEDIUM": "primary", "4-NOT SPECIFIED": "secondary", "5-LOW": "tertiary"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat: parts on a lattice the size of a city."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", (F.col("id") % 200 * 0.0005 + 139.0).alias("lon"), (F.floor(F.col("id") / 200) * 0.0005 + 35.0).alias("lat"))


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id: the parts of an order's lines, in order."""
    return ways(spark, sf_dir).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))


def way_tags(priority: Column, status: Column) -> Column:
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), priority)
    extra = F.when(status == "O", F.array(pair("bridge", F.lit("yes")))).when(status == "P", F.array(pair("tunnel", F.lit("yes")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    return F.concat(F.array(pair("highway", kind)), extra, F.array(pair("name", priority)))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, refs, tags, status, priority, date; only orders with lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["l_partkey"]).alias("refs"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), way_tags(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("tags"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("custkey"))
    return o.join(refs, "id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, segment, members: a customer and its orders; every tenth customer has the next one as a member too."""
    o = table(spark, sf_dir, "orders")
    member = F.struct(F.col("o_orderkey").alias("id"), F.lit("way").alias("type"), F.when(F.col("o_orderstatus") == "P", "inner").otherwise("outer").alias("role"))
    own = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    below = F.when(F.col("id") % 10 == 0, F.array(F.struct((F.col("id") + 1).alias("id"), F.lit("relation").alias("type"), F.lit("").alias("role")))).otherwise(F.array().cast("array<struct<id:bigint,type:string,role:string>>"))
    return c.join(own, "id").select("id", "segment", F.concat("members", below).alias("members"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with x, y."""
    return nodes(spark, sf_dir).withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, k: events as camera moves."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))


# The same in DuckDB.
NODES_SQL = "nodes AS (SELECT p_partkey AS id, p_partkey % 200 * 0.0005::DOUBLE + 139.0::DOUBLE AS lon, floor(p_partkey / 200) * 0.0005::DOUBLE + 35.0::DOUBLE AS lat FROM part)"
POINTS_SQL = NODES_SQL + ", points AS (SELECT *, radians(lon) * 6378137.0::DOUBLE AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS y FROM nodes)"
REFS_SQL = "refs AS (SELECT l_orderkey AS way_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS pos, l_partkey AS node_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"
WAYS_SQL = "ways AS (SELECT o_orderkey AS id, o_custkey AS custkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
MEMBERS_SQL = "members AS (SELECT o_custkey AS rel_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_orderkey AS way_id, o_orderstatus = 'P' AS is_hole FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"
REQUESTS_SQL = "requests AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k')::INT AS k FROM events)"
