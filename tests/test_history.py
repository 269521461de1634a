"""Changes kept in versions, and the state read as of any time (C10 stream)."""

import os

import numpy as np
import pytest

from relflow.sinks.history import ChangeHistory
from relflow.streaming.sessions import stream_snapshots

SCHEMA = "actor1 string, actor2 string, ts long, k long, raw_score double"


def changes(n=400, seed=0, late=0.0):
    r = np.random.default_rng(seed)
    ts = np.sort(r.integers(0, 100_000, n))
    ts = np.where(r.random(n) < late, r.integers(0, 100_000, n), ts)
    pair = np.where(r.random(n) < 0.4, 0, r.integers(1, 9, n))          # a hot pair
    return [("A", f"B{p}", int(t), i, float(i)) for i, (p, t) in enumerate(zip(pair, ts))]


def plain(rows, times):
    out = set()
    for t in times:
        last = {}
        for a, b, ts, k, v in rows:
            if ts <= t and (ts, k) >= last.get((a, b), (-1, -1, 0))[:2]:
                last[a, b] = (ts, k, v)
        out |= {(t, a, b, v) for (a, b), (_, _, v) in last.items()}
    return out


def asked(spark, times):
    return spark.createDataFrame([(int(t),) for t in times], "t long").selectExpr("timestamp_millis(t) AS request_ts")


@pytest.mark.parametrize("late", [0.0, 0.3])
def test_as_of_equals_replay(spark, tmp_path, late):
    rows = changes(late=late)
    h = ChangeHistory(spark, str(tmp_path / "h"), order=("k",), base_every=2)
    for b in range(5):
        h.append(spark.createDataFrame(rows[b * 80:(b + 1) * 80], SCHEMA), b)
        h.append(spark.createDataFrame(rows[:10], SCHEMA), b)              # a batch id that is committed: nothing
    assert [x["batch"] for x in h._read_pointer()["bases"]] == [1, 3]
    times = [-5, 0, rows[0][2], 20_000, 45_000, 70_000, 99_999, 10**9]
    got = {(r["request_ts"], r["actor1"], r["actor2"], r["raw_score"]) for r in h.as_of(asked(spark, times)).collect()}
    assert got == plain(rows, times)
    assert h.times() == (min(r[2] for r in rows), max(r[2] for r in rows))
    assert {(r["actor2"], r["raw_score"]) for r in h.read().collect()} == {(b, v) for _, _, b, v in plain(rows, [10**9])}


def test_reads_only_a_base_and_what_came_after(spark, tmp_path):
    rows = changes()
    h = ChangeHistory(spark, str(tmp_path / "h"), order=("k",), base_every=2)
    for b in range(5):
        h.append(spark.createDataFrame(rows[b * 80:(b + 1) * 80], SCHEMA), b)
    files = []
    real = h._rows
    h._rows = lambda base, versions: files.append((base and base["batch"], [v["batch"] for v in versions])) or real(base, versions)
    h.as_of(asked(spark, [10**9, 10**9 + 1])).count()
    assert files == [(3, [4])]


def test_request_stream_and_empty_history(spark, tmp_path):
    h = ChangeHistory(spark, str(tmp_path / "h"), order=("k",))
    assert h.as_of(asked(spark, [5])).count() == 0 and h.read() is None
    rows = changes(60, 2)
    h.append(spark.createDataFrame([], SCHEMA), 0)
    h.append(spark.createDataFrame(rows, SCHEMA), 1)
    first = min(r[2] for r in rows)
    asked(spark, [first - 1, 50_000, 50_000, 90_000]).write.parquet(str(tmp_path / "req"))
    stream = spark.readStream.schema("request_ts timestamp").parquet(str(tmp_path / "req"))
    stream_snapshots(stream, h, str(tmp_path / "out"), str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    got = {(r["request_ts"], r["actor1"], r["actor2"], r["raw_score"])
           for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    assert got == plain(rows, [50_000, 90_000]) | {(first - 1, None, None, None)}


def test_no_nested_loop_join(spark, tmp_path):
    from relflow.streaming.sessions import _of_every_request
    state = spark.createDataFrame([("A", f"B{i}", float(i)) for i in range(50)], "actor1 string, actor2 string, raw_score double")
    reqs = spark.createDataFrame([(1,), (2,)], "request_ts long")
    out = _of_every_request(reqs, state, "raw_score")
    assert out.count() == 100 and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    h = ChangeHistory(spark, str(tmp_path / "h"), order=("k",))
    h.append(spark.createDataFrame(changes(50), SCHEMA), 0)
    plan = h.as_of(asked(spark, [50_000]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert os.path.isdir(str(tmp_path / "h"))
