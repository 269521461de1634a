"""Levels of the tree fold."""

from pyspark.sql import functions as F

from relflow.operators import state as C


def test_levels_that_bound_no_group_are_left_out(spark):
    i = F.col("id")
    df = spark.range(3000).select((i % 3).cast("string").alias("actor1"), F.lit("b").alias("actor2"), (i % 41 * 86400000).alias("ts"),
                                  (i * 7919 % 3000 * 100000).alias("k1"), i.alias("k2"), i.alias("k3"), i.alias("k4"),
                                  (i % 7 - 3).cast("double").alias("score")).cache()
    whole = C.relation_scores_by_day(df, bound=5.0)
    cut = C.relation_scores_by_day(df, bound=5.0, fanout=8)         # days of 24 rows, pairs of 41 days
    levels = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert levels(whole) == 2 < levels(cut)         # days, pairs
    rows = lambda x: {r["actor1"]: r for r in x.collect()}
    a, b, c = rows(whole), rows(cut), rows(C.relation_scores(df, bound=5.0))
    assert len(a) == 3
    for k in a:
        for f in ("raw_score", "norm", "last_ts", "n"):
            assert abs(a[k][f] - b[k][f]) < 1e-9 and abs(a[k][f] - c[k][f]) < 1e-9
