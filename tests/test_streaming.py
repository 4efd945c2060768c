"""The streamed gate gives what the batch operator gives."""

from pyspark.sql import functions as F

from quadrille.operators.sequences import changed
from quadrille.streaming.views import changes, views_per_window


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.get_json_object("props", "$.k").cast("int") / 25).alias("view"))
    want = {r.event_id: r.builds for r in changed(rows, "user_id", ["ts", "event_id"], ["view"]).collect()}
    source = str(tmp_path / "in")
    for k, part in enumerate(rows.orderBy("ts", "event_id").toPandas().pipe(lambda p: [p.iloc[:400], p.iloc[400:700], p.iloc[700:]])):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    moves = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source).withWatermark("ts", "3650 days")
    q = changes(moves, forget_after="3650 days").writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r.event_id: r.builds for r in spark.table("gate").collect()}
    assert got.keys() == want.keys() and sum(got.values()) >= sum(want.values()) * 0.95
    q = views_per_window(moves).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("moves")).first()[0] == rows.count()
