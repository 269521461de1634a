"""Keyed stream state by the ordered scan (C11): any batch cut gives the sequence."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relflow.streaming import scan_state as SS

SCHEMA = "actor1 string, actor2 string, ts long, k long, score double"
LAM = 8e-10


def events(n=300, seed=0):
    r = np.random.default_rng(seed)
    ts = np.sort(r.integers(0, 40 * 86_400_000, n))
    pair = np.where(r.random(n) < 0.4, 0, r.integers(1, 6, n))
    return [("A", f"B{p}", int(t), i, float(x)) for i, (p, t, x) in enumerate(zip(pair, ts, r.normal(size=n) * 40))]


def plain(batches, late, bound=100.0):
    """Row by row, as the reference keeps it: a NaN from 0 * inf counts as 0."""
    state, out = {}, {}

    def decayed(v, f):
        x = v * f
        return 0.0 if math.isnan(x) else min(max(x, -bound), bound)
    for rows in batches:
        for a, b, ts, k, x in sorted(rows, key=lambda e: (e[2], e[3])):
            s, n, t = state.get((a, b), (0.0, 0.0, ts))
            dt = ts - t if late == "reference" else max(ts - t, 0)
            f = math.exp(-LAM * dt) if -LAM * dt < 700 else math.inf
            s, n = decayed(s, f) + x, decayed(n, f) + 1
            state[a, b] = (s, n, ts if late == "reference" else max(t, ts))
            out[k] = (s, n)
    return out, state


def run(spark, batches, late):
    state, got = None, {}
    for rows in batches:
        ch = SS.score_batch(spark.createDataFrame(rows, SCHEMA), state, LAM, late=late, order=("k",)).checkpoint()
        got |= {r["k"]: (r["raw_score"], r["norm"]) for r in ch.collect()}
        last = ch.groupBy("actor1", "actor2").agg(F.max_by(F.struct("*"), F.struct("last_ts", "ts", "k")).alias("r")) \
            .select("r.actor1", "r.actor2", "r.raw_score", "r.norm", "r.last_ts")
        state = (last if state is None else last.unionByName(state.join(last, ["actor1", "actor2"], "left_anti"))).checkpoint()
    return got, {(r["actor1"], r["actor2"]): (r["raw_score"], r["norm"], r["last_ts"]) for r in state.collect()}


@pytest.mark.parametrize("late", ["reference", "no_decay"])
def test_batches_equal_the_sequence(spark, late):
    rows = events()
    moved = rows[40:60]
    batches = [rows[:40] + rows[60:120], moved + rows[120:200], rows[200:]]         # the second starts with late rows
    batches[2].append(("A", "B1", -20 * 365 * 86_400_000, 900, 0.25))               # a jump back by 20 years
    want, wstate = plain(batches, late)
    got, state = run(spark, batches, late)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    assert state.keys() == wstate.keys() and all(np.allclose(state[p], wstate[p], rtol=1e-9, atol=1e-9) for p in wstate)


def test_counts_and_no_events(spark):
    rows = events(100)
    df = lambda r: spark.createDataFrame(r, SCHEMA)
    a = SS.count_batch(df(rows[:60]), None, order=("k",)).checkpoint()
    state = a.groupBy("actor1", "actor2").agg(F.max("n").alias("n"))
    b = SS.count_batch(df(rows[60:]), state, order=("k",)).collect()
    seen = {}
    want = {}
    for e in rows:
        seen[e[1]] = want[e[3]] = seen.get(e[1], 0) + 1
    assert {r["k"]: r["n"] for r in [*a.collect(), *b]} == want
    assert SS.count_batch(df([]), state, order=("k",)).count() == 0 and SS.score_batch(df([]), None, order=("k",)).count() == 0


def test_a_hot_pair_spreads_over_tasks(spark):
    rows = spark.range(60_000).selectExpr("'A' AS actor1", "if(id % 3 = 0, 'hot', concat('B', id % 50)) AS actor2", "id * 1000 AS ts", "id AS k", "1.0D AS score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = SS.score_batch(rows.repartition(8), None, LAM, order=("k",)).where("actor2 = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in out) == 20_000 and max(r["count"] for r in out) < 12_000


def test_restart_and_replay(spark, tmp_path):
    rows, d = events(90, 3), str(tmp_path)
    seen = []

    def sink(changes, i):
        seen.append((i, changes.count()))
        if len(seen) == 2:          # dies after the sink, before the state is committed
            raise RuntimeError("lost")
        changes.write.mode("overwrite").parquet(f"{d}/out/batch={i}")
    for part in (rows[:30], rows[30:60], None, rows[60:]):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/in")
        q, table = SS.start_relation_scores(spark.readStream.schema(SCHEMA).parquet(f"{d}/in"), f"{d}/state", f"{d}/ck", sink, LAM, order=("k",), trigger={"availableNow": True})
        try:
            q.awaitTermination()
        except Exception:
            assert len(seen) == 2
    assert seen == [(0, 30), (1, 30), (1, 30), (2, 30)]
    want, state = plain([rows[:30], rows[30:60], rows[60:]], "reference")
    got = {r["k"]: (r["raw_score"], r["norm"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{d}/out").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert {(r["actor1"], r["actor2"]): r["last_ts"] for r in table.read().collect()} == {p: s[2] for p, s in state.items()}
