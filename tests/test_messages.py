"""Snapshot messages of bounded bytes."""

import json

from pyspark.sql import functions as F

from relflow.sinks import writers as W

SCHEMA = "request_ts long, actor1 string, actor2 string, n long"


def test_arrays_in_turn_are_the_whole_array(spark):
    rows = [(7, f"Ä{i:04d}", "x" * (i % 50), i) for i in range(3000)] + [(8, "A", "B", 1), (9, None, None, None), (10, "A", "y" * 900, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = W.bounded_snapshot_messages(df, "n", max_bytes=600).collect()
    whole = {r["value"] for r in W.snapshot_messages(df, "n").collect()}
    joined = {}
    for r in sorted(got, key=lambda r: (r["request_ts"], r["part"])):
        joined.setdefault(r["request_ts"], []).extend(json.loads(r["value"]))
        assert len(r["value"].encode()) <= 600 + 100 or len(json.loads(r["value"])) == 1
    assert len(joined) == 4 and sum(r["request_ts"] == 7 for r in got) > 100 and joined[9] == []
    assert sorted(map(repr, joined.values())) == sorted(repr(json.loads(w)) for w in whole)
    assert W.bounded_snapshot_messages(df.limit(0), "n").count() == 0


def test_one_hot_request_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("request_ts"), F.format_string("P%05d", "id").alias("actor1"), F.lit("Q").alias("actor2"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = W.bounded_snapshot_messages(df, "n", max_bytes=4096).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 3
