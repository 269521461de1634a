"""Online factorisation (F11): equal to a single-machine replay, error falls."""

import numpy as np
import pandas as pd

from conftest import SF_SMALL
from relflow import fixtures as fx
from relflow.functions.jrandom import java_random_doubles
from relflow.operators import mf


def replay_mf(ratings: pd.DataFrame, users: dict, items: dict, lr: float, d: int, epochs: int = 1,
              order=("ts",)) -> tuple[dict, dict]:
    """Single-machine replay of the same block order (tests)."""
    users = {k: np.array(v, dtype=np.float64) for k, v in users.items()}
    items = {k: np.array(v, dtype=np.float64) for k, v in items.items()}
    for _ in range(epochs):
        for s in range(d):
            for b in range(d):
                blk = ratings[(ratings.user_id % d == b) & (ratings.item_id % d == (b + s) % d)]
                blk = blk.sort_values(list(order) + ["user_id", "item_id"], kind="stable")
                for row in blk.itertuples():
                    u, v = users[row.user_id], items[row.item_id]
                    e = row.rating - float(u @ v)
                    du, dv = lr * e * v, lr * e * u
                    u += du
                    v += dv
    return users, items


def test_train_mf_equals_replay_and_learns(spark):
    r = fx.ratings(spark, SF_SMALL).select("user_id", "item_id", "rating", "ts", "k1", "k2")
    d, k, lr = 3, 4, 0.05
    from relflow.operators import factors as FX
    users, items = mf.train_mf(r, k=k, lr=lr, init_user=FX.seeded_init(k), init_item=FX.seeded_init(k),
                               epochs=1, strata=d, order=("ts", "k1", "k2"))
    got_u = {row.user_id: np.array(row.factors) for row in users.collect()}
    got_i = {row.item_id: np.array(row.factors) for row in items.collect()}
    pdf = r.toPandas()
    u0 = {int(i): java_random_doubles(int(i), k) for i in pdf.user_id.unique()}
    i0 = {int(i): java_random_doubles(int(i), k) for i in pdf.item_id.unique()}
    exp_u, exp_i = replay_mf(pdf, u0, i0, lr, d, order=("ts", "k1", "k2"))
    assert set(got_u) == set(exp_u) and set(got_i) == set(exp_i)
    assert max(np.abs(got_u[i] - exp_u[i]).max() for i in exp_u) < 1e-9
    assert max(np.abs(got_i[i] - exp_i[i]).max() for i in exp_i) < 1e-9
    before = mf.squared_error(r, spark.createDataFrame([(int(a), b) for a, b in u0.items()], "user_id long, factors array<double>"),
                              spark.createDataFrame([(int(a), b) for a, b in i0.items()], "item_id long, factors array<double>"))
    after = mf.squared_error(r, users, items)
    assert after < before


def test_the_model_does_not_depend_on_the_machine(spark):
    r = fx.ratings(spark, SF_SMALL).select("user_id", "item_id", "rating", "ts", "k1", "k2")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            users, _ = mf.train_mf(r.repartition(int(n)), k=3, order=("ts", "k1", "k2"))
            got.append({x.user_id: x.factors for x in users.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
