"""User folds as Spark expressions (C7): equal to a plain fold at any cut; no hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relflow.operators import folds
from relflow.operators import state as C
from relflow.operators.folds import Monoid, Sequential, monoid_fold, sequential_fold

SCHEMA = "actor1 string, actor2 string, k long, x double"


def rows(n=500, seed=0):
    r = np.random.default_rng(seed)
    return [("A", f"B{0 if r.random() < 0.4 else r.integers(1, 40)}", int(i), float(x)) for i, x in zip(r.permutation(n), r.integers(-9, 9, n))]


def by_key(data):
    out = {}
    for a, b, _, x in sorted(data, key=lambda e: e[2]):
        out.setdefault((a, b), []).append(x)
    return out


# not commutative: the values as text, in order
TEXT = Monoid(lambda x: x.cast("int").cast("string"), lambda a, b: F.concat(a, F.lit(","), b), lambda p: p)


@pytest.mark.parametrize("fanout", [2, 7, 4096])
def test_monoid_keeps_the_order(spark, fanout):
    data = rows()
    got = monoid_fold(spark.createDataFrame(data, SCHEMA).repartition(5), "x", TEXT, C.PAIR, ("k",), fanout).collect()
    assert {(r["actor1"], r["actor2"]): (r["value"], r["n"]) for r in got} == {k: (",".join(str(int(x)) for x in v), len(v)) for k, v in by_key(data).items()}


@pytest.mark.parametrize("fanout", [3, 65_536])
def test_sequential_update(spark, fanout):
    data = rows(120, 2)
    update = Sequential(lambda s, x: F.when(x > s, x).otherwise(s * 0.5 + 1))          # can't be cut
    got = sequential_fold(spark.createDataFrame(data, SCHEMA), "x", update, C.PAIR, ("k",), fanout).collect()
    want = {}
    for key, v in by_key(data).items():
        s = v[0]
        for x in v[1:]:
            s = x if x > s else s * 0.5 + 1
        want[key] = (s, len(v))
    assert {(r["actor1"], r["actor2"]): (r["value"], r["n"]) for r in got} == want


def test_no_group_holds_a_hot_key(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("'A' AS actor1", "if(id % 3 < 2, 'hot', concat('B', id % 50)) AS actor2", "id AS k", "1.0D AS x")
    in_order = folds._in_order
    monkeypatch.setattr(folds, "_in_order", lambda items: F.when(F.size(items) <= 64, in_order(items)).otherwise(F.raise_error(F.lit("group too large"))))
    total = Monoid(lambda x: x, lambda a, b: a + b)
    got = {r["actor2"]: r["value"] for r in monoid_fold(df, "x", total, C.PAIR, ("k",), 64).collect()}
    assert got["hot"] == sum(1 for i in range(20_000) if i % 3 < 2) and sum(got.values()) == 20_000


def test_empty_nulls_and_feed(spark):
    df = spark.createDataFrame([("A", None, 1, 2.0), ("A", None, 2, None), ("B", "A", 1, 5.0)], SCHEMA)
    first = Monoid(lambda x: x, lambda a, b: F.coalesce(a, b))
    got = {(r["actor1"], r["actor2"]): (r["value"], r["n"]) for r in monoid_fold(df, "x", first, C.PAIR, ("k",)).collect()}
    assert got == {("A", None): (2.0, 2), ("B", "A"): (5.0, 1)}
    got = {(r["actor1"], r["actor2"]): (r["value"], r["n"]) for r in sequential_fold(df, "x", Sequential(lambda s, x: F.coalesce(x, s)), C.PAIR, ("k",), 1).collect()}
    assert got == {("A", None): (2.0, 2), ("B", "A"): (5.0, 1)}
    assert monoid_fold(df.limit(0), "x", first, C.PAIR, ("k",)).count() == 0
    assert sequential_fold(df.limit(0), "x", Sequential(lambda s, x: s), C.PAIR, ("k",)).count() == 0
    with pytest.raises(ValueError):
        C.pair_fold(df, "x", first, feed=True)
