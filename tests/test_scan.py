"""The skew-safe ordered scan equals a sequential fold, whatever the skew."""

import math

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from relflow.functions import clampmap as cm
from relflow.operators import state as C
from relflow.plans.ordered_scan import Channel, ordered_scan


def _sequential(rows, lam, bound):
    out, state = [], {}
    for key, t, oid, x in rows:
        s, n, last = state.get(key, (0.0, 0.0, t))
        f = math.exp(-lam * (t - last))
        s = max(min(s * f, bound), -bound) + x
        n = max(min(n * f, bound), -bound) + 1.0
        state[key] = (s, n, t)
        out.append((key, oid, s, n))
    return out, state


def _data(seed, n=4000, hot_share=0.6):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot_share, "HOT", rng.choice(["A", "B", "C", "D"], n))
    t = rng.integers(0, 20, n) * 86400000
    x = rng.choice([0.01, 0.02, -0.01, -0.02, 3.0, -3.0], n)
    pdf = pd.DataFrame({"actor1": keys, "actor2": "Z", "ts": t, "k1": np.arange(n), "k2": 0, "k3": 0,
                        "k4": 0, "score": x})
    rows = sorted(zip(pdf.actor1, pdf.ts, pdf.k1, pdf.score), key=lambda r: (r[0], r[1], r[2]))
    return pdf, rows


def test_relation_fold_with_hot_key_and_clamp(spark):
    pdf, rows = _data(1)
    lam, bound = 1e-9, 5.0   # small bound: the clamp is reached
    df = spark.createDataFrame(pdf).repartition(5)
    seq, final = _sequential(rows, lam, bound)
    feed = C.relation_scores_feed(df, lam=lam, bound=bound).toPandas()
    got = {(r.actor1, r.k1): (r.raw_score, r.norm) for r in feed.itertuples()}
    for key, oid, s, n in seq:
        gs, gn = got[(key, oid)]
        assert abs(gs - s) < 1e-9 * max(1, abs(s)) and abs(gn - n) < 1e-9 * max(1, n)
    state = C.relation_scores(df, lam=lam, bound=bound).toPandas()
    for r in state.itertuples():
        s, n, last = final[r.actor1]
        assert abs(r.raw_score - s) < 1e-9 * max(1, abs(s)) and r.last_ts == last
    by_day = C.relation_scores_by_day(df, lam=lam, bound=bound, fanout=16).toPandas()
    for r in by_day.itertuples():
        s, n, last = final[r.actor1]
        assert abs(r.raw_score - s) < 1e-9 * max(1, abs(s)) and abs(r.norm - n) < 1e-9 * max(1, n)


def test_hot_key_spreads_over_partitions(spark):
    pdf, _ = _data(2, n=20000, hot_share=0.9)
    df = spark.createDataFrame(pdf)
    from relflow.plans.ordered_scan import _prepare
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts, _ = _prepare(df, ["actor1", "actor2"], ["ts", "k1"], [Channel("c", F.lit(1.0), F.lit(1.0))], [], None)
        sizes = parts.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes.max() < 0.5 * sizes.sum()   # no task holds the hot key


def test_locf_and_lag(spark):
    pdf = pd.DataFrame({"g": ["a"] * 6 + ["b"] * 3, "o": list(range(6)) + list(range(3)),
                        "v": [None, 2.0, None, None, 5.0, None, None, None, 7.0]})
    df = spark.createDataFrame(pdf, "g string, o long, v double")
    x = F.col("v")
    ch = Channel("f", a=F.when(x.isNull(), 1.0).otherwise(0.0), b=F.coalesce(x, F.lit(0.0)), init=-1.0)
    res = ordered_scan(df, ["g"], ["o"], [ch], keep=["v"], exclusive=True).orderBy("g", "o").toPandas()
    assert res["f"].tolist() == [-1, 2, 2, 2, 5, 5, -1, -1, 7]
    assert res["f_prev"].tolist()[:3] == [None, -1, 2] or (pd.isna(res["f_prev"].iloc[0]) and res["f_prev"].tolist()[1:3] == [-1, 2])


def test_weighted_and_sum_updates(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"actor1": rng.choice(["X", "Y"], n, p=[0.9, 0.1]), "actor2": "Z",
                        "k1": np.arange(n), "k2": 0, "k3": 0, "k4": 0, "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(4)
    w = 0.8
    exp = {}
    for key, v in zip(pdf.actor1, pdf.v):
        exp[key] = v if key not in exp else exp[key] * w + v * (1 - w)
    got = C.pair_fold(df, "v", C.weighted(w), feed=False).toPandas()
    for r in got.itertuples():
        assert abs(r.value - exp[r.actor1]) < 1e-9
    py = C.pair_fold(df, "v", lambda old, new: old * w + new * (1 - w), feed=False).toPandas()
    for r in py.itertuples():
        assert abs(r.value - exp[r.actor1]) < 1e-9
    sums = C.pair_fold(df, "v", C.sum_update(), feed=False).toPandas()
    for r in sums.itertuples():
        assert abs(r.value - pdf[pdf.actor1 == r.actor1].v.sum()) < 1e-9


maps = st.tuples(st.floats(0, 2), st.floats(-5, 5), st.floats(-10, 0), st.floats(0, 10))


@settings(max_examples=200, deadline=None)
@given(st.lists(maps, min_size=1, max_size=12), st.floats(-20, 20))
def test_composition_equals_sequential(ms, s0):
    seq = s0
    for a, b, lo, hi in ms:
        seq = min(max(a * seq + b, lo), hi)
    arr = tuple(np.array([m[i] for m in ms]) for i in range(4))
    pre = cm.segmented_scan_np(arr, np.zeros(len(ms), dtype=int))
    last = tuple(x[-1:] for x in pre)
    got = float(cm.apply_np(last, np.array([s0]))[0])
    assert abs(got - seq) < 1e-9 * max(1.0, abs(seq))


def test_many_partitions_and_small_batches(spark):
    """Keys spanning many partitions and many Arrow batches inside one."""
    pdf, rows = _data(5, n=6000, hot_share=0.5)
    lam, bound = 1e-9, 2.0
    seq, final = _sequential(rows, lam, bound)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "50",
            "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(pdf).repartition(7)
        feed = C.relation_scores_feed(df, lam=lam, bound=bound).toPandas()
        state = C.relation_scores(df, lam=lam, bound=bound).toPandas()
        locf_in = pdf.assign(v=np.where(np.arange(len(pdf)) % 3 == 0, np.nan, pdf.k1.astype(float)))
        x = F.col("v")
        ch = Channel("f", a=F.when(x.isNull() | F.isnan(x), 1.0).otherwise(0.0),
                     b=F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x), init=-1.0)
        locf = ordered_scan(spark.createDataFrame(locf_in[["actor1", "k1", "v"]]), ["actor1"], ["k1"], [ch],
                            keep=["v"], exclusive=True).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {(r.actor1, r.k1): (r.raw_score, r.norm) for r in feed.itertuples()}
    assert len(got) == len(seq)
    for key, oid, s, n in seq:
        gs, gn = got[(key, oid)]
        assert abs(gs - s) < 1e-9 * max(1, abs(s)) and abs(gn - n) < 1e-9 * max(1, n)
    for r in state.itertuples():
        assert abs(r.raw_score - final[r.actor1][0]) < 1e-9 * max(1, abs(final[r.actor1][0]))
    # last non-null value and previous value, checked against pandas
    exp = locf_in.sort_values(["actor1", "k1"])
    exp_f = exp.groupby("actor1")["v"].ffill().fillna(-1.0)
    got_f = locf.set_index(["actor1", "k1"]).loc[list(zip(exp.actor1, exp.k1))]
    assert np.allclose(got_f["f"].to_numpy(), exp_f.to_numpy())
    prev = exp_f.groupby(exp.actor1).shift(1)
    assert np.allclose(got_f["f_prev"].to_numpy(dtype=float), prev.to_numpy(dtype=float), equal_nan=True)
