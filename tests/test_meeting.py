"""Pairs that meet their vectors in cells."""

import pytest
from pyspark.sql import functions as F

from relflow.operators import factors as FX
from relflow.operators import meeting


def _tables(spark):
    pairs = spark.range(3000).select((F.col("id") % 61).cast("int").alias("user_id"), F.when(F.col("id") % 50 != 7, F.col("id") % 37).alias("item_id"),
                                     F.col("id").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") / 10).alias("rating"))
    vector = lambda n: F.when(F.col("id") == 11, None).otherwise(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i * F.col("id"))))
    ids = spark.range(57).unionAll(spark.range(5, 8)).unionAll(spark.range(1).select(F.lit(None).cast("long")))      # some twice, some missing, one null
    users = ids.select(F.col("id").alias("user_id"), vector(3).alias("factors"))
    items = spark.range(35).unionAll(spark.range(6, 9)).select(F.col("id").alias("item_id"), vector(3).alias("factors"))
    return pairs, users, items


def _rows(df):
    return sorted(map(str, df.select("k", "user_id", "item_id", "rating", "_u", "_v").collect()))


@pytest.mark.parametrize("options", [{}, {"cell_pairs": 200}, {"block_bytes": 300}])
def test_cells_give_the_rows_of_both_joins(spark, options):
    pairs, users, items = _tables(spark)
    got = meeting.with_vectors(pairs, users, items, **options)
    want = pairs.join(users.withColumnRenamed("factors", "_u"), "user_id").join(items.withColumnRenamed("factors", "_v"), "item_id")
    assert got.dtypes == want.dtypes
    assert _rows(got) == _rows(want)


def test_no_vector_is_joined_to_each_pair(spark):
    pairs, users, items = _tables(spark)
    for df in (FX.score_pairs(pairs, users, items), FX.sgd_deltas(pairs, users, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan


def test_few_pairs_are_joined(spark):
    pairs, users, items = _tables(spark)
    got = meeting.with_vectors(pairs.limit(2), users, items, block_bytes=100)
    assert "Join" in got._jdf.queryExecution().executedPlan().toString()


def test_default_deltas_are_made_in_the_cells(spark):
    pairs, users, items = _tables(spark)
    near = lambda v: v if v is None else [x if x is None else round(x, 9) for x in v]
    rows = lambda df: sorted(str((r["k"], r["user_id"], r["item_id"], r["rating"], near(r["du"]), near(r["dv"]))) for r in df.collect())
    own = FX.sgd_deltas(pairs, users, items, 0.1, updater=FX.sgd_updater(0.1))
    got = FX.sgd_deltas(pairs, users, items, 0.1)
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")       # Spark scaled each pair's vectors before
    assert got.dtypes == own.dtypes and rows(got) == rows(own)
    uneven = items.withColumn("factors", F.when(F.col("item_id") % 5 == 0, F.slice("factors", 1, 2)).otherwise(F.col("factors")))
    assert rows(FX.sgd_deltas(pairs, users, uneven, 0.1)) == rows(FX.sgd_deltas(pairs, users, uneven, 0.1, updater=FX.sgd_updater(0.1)))
    assert FX.sgd_deltas(pairs, users, items, 0.1, sides=("item",)).columns == [c for c in own.columns if c != "du"]
