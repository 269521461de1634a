"""Factor initialisers and updates."""

import pytest
from pyspark.sql import functions as F

from relflow.functions.jrandom import java_random_doubles, next_doubles
from relflow.operators import factors as FX


@pytest.mark.parametrize("seed", [42, 0, -7, 2**31 - 1])
def test_seeded_init_is_java_random(spark, seed):
    jr = spark.sparkContext._jvm.java.util.Random(seed)
    java = [jr.nextDouble() for _ in range(10)]
    got = spark.range(1).select(next_doubles(F.lit(seed), 10)).first()[0]
    assert got == java == java_random_doubles(seed, 10)


def test_ranged_init(spark):
    ids = spark.range(5).withColumnRenamed("id", "item_id")
    v = FX.init_factors(ids, "item_id", FX.ranged_init(10, -0.01, 0.01)).collect()
    for r in v:
        assert all(-0.01 <= x < 0.01 for x in r.factors) and len(r.factors) == 10


def test_python_init(spark):
    ids = spark.range(3).withColumnRenamed("id", "user_id")
    v = FX.init_factors(ids, "user_id", FX.python_init(lambda i: [i, 2 * i])).orderBy("user_id").collect()
    assert [list(r.factors) for r in v] == [[0, 0], [1, 2], [2, 4]]


def test_apply_deltas_sums_and_fails_on_nan(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0])], "id long, factors array<double>")
    d = spark.createDataFrame([(1, [0.5, 0.5]), (1, [1.0, -1.0]), (2, [1.0, 1.0])], "id long, delta array<double>")
    out = {r.id: list(r.factors) for r in FX.apply_deltas(f, d, "id", FX.seeded_init(2)).collect()}
    assert out[1] == [2.5, 1.5]
    init2 = java_random_doubles(2, 2)
    assert out[2] == [init2[0] + 1.0, init2[1] + 1.0]
    bad = spark.createDataFrame([(1, [float("nan"), 0.0])], "id long, delta array<double>")
    with pytest.raises(Exception):
        FX.apply_deltas(f, bad, "id").collect()
