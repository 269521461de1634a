"""Dense ids in order, without Python or a scan of whole rows."""

from pyspark.sql import functions as F

from relflow.sources.ids import assign_ordered_ids


def test_ordered_ids_are_dense_and_made_without_python(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000 % 900).alias("a"), "id", F.lit("x").alias("c"))
    got = assign_ordered_ids(df, ["a", "id"], out="n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["a", "id", "c", "n"] and "InPandas" not in plan and "ExistingRDD" not in plan    # a checkpoint of the scan before
    rows = got.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(5000))
    keys = [(r["a"], r["id"]) for r in rows]
    assert keys == sorted(keys)
    assert assign_ordered_ids(df.limit(0), ["a"], out="n").count() == 0
