"""Stream = batch: the same rows split over several files, read as a stream."""

import os

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relflow import queries as Q
from relflow.operators import state as C
from relflow.sinks.writers import LatestStateTable, change_messages, snapshot_messages
from relflow.streaming import relation_state as RS


def _split_to_files(df, path, n):
    pdf = df.toPandas().sort_values(["ts", "k1", "k2", "k3", "k4"]).reset_index(drop=True)
    os.makedirs(path, exist_ok=True)
    step = (len(pdf) + n - 1) // n
    for i in range(n):
        pdf.iloc[i * step:(i + 1) * step].to_parquet(f"{path}/part-{i:03d}.parquet", index=False)
    return pdf


def _rows(pdf, value):
    key = ["actor1", "actor2", "k1", "k2", "k3", "k4"]
    return sorted(tuple(r[:-1]) + (round(float(r[-1]), 9),) for r in pdf[key + [value]].itertuples(index=False))


def _collect_stream(spark, sdf, ckpt, name):
    q = (sdf.writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}").toPandas()


def test_stream_relation_scores_equal_batch(spark, tmpdir_run):
    sig = Q.signed(spark, SF_SMALL).select("actor1", "actor2", "ts", "k1", "k2", "k3", "k4", "score")
    src = f"{tmpdir_run}/events"
    _split_to_files(sig, src, 4)
    stream = spark.readStream.schema(sig.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _collect_stream(spark, RS.stream_relation_scores(stream), f"{tmpdir_run}/ck", "rel_stream")
    batch = C.relation_scores_feed(sig).toPandas()
    assert _rows(out, "score") == _rows(batch, "score")


def test_stream_counts_equal_batch(spark, tmpdir_run):
    p = Q.pairs(spark, SF_SMALL).withColumn("ts", F.lit(0).cast("long")) \
         .select("actor1", "actor2", "ts", "k1", "k2", "k3", "k4")
    src = f"{tmpdir_run}/pairs"
    _split_to_files(p, src, 3)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _collect_stream(spark, RS.stream_counts(stream), f"{tmpdir_run}/ck", "cnt_stream")
    batch = C.interaction_counts_feed(p).toPandas()
    assert _rows(out, "n") == _rows(batch, "n")


def test_stream_windowed_counts_closed_windows_equal_batch(spark, tmpdir_run):
    from relflow.operators import interactions as B
    d = B.event_time_or(Q.pairs(spark, SF_SMALL)).select("actor1", "actor2", "ts", "k1", "k2", "k3", "k4")
    src = f"{tmpdir_run}/w"
    pdf = _split_to_files(d, src, 3)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sdf = RS.stream_counts_windowed(stream, width="7 days")
    q = (sdf.writeStream.format("memory").queryName("win_stream").outputMode("append")
         .option("checkpointLocation", f"{tmpdir_run}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.sql("SELECT * FROM win_stream").toPandas()
    batch = C.interaction_counts_windowed(d, width="7 days").toPandas()
    # the stream emits windows closed by the watermark (max event time) only
    wm = int(pdf["ts"].max())
    closed = batch[batch["window_end"] <= wm]
    key = ["actor1", "actor2", "window_start"]
    m = out.merge(closed, on=key, suffixes=("_s", "_b"))
    assert len(out) == len(closed) == len(m)
    assert (m["n_s"] == m["n_b"]).all()


def test_late_event_policy(spark, tmpdir_run):
    import pandas as pd
    rows = [("B", "A", 100 * 86400000, 1, 0, 0, 0, 0.01), ("B", "A", 50 * 86400000, 2, 0, 0, 0, 0.02)]
    cols = ["actor1", "actor2", "ts", "k1", "k2", "k3", "k4", "score"]
    os.makedirs(f"{tmpdir_run}/late", exist_ok=True)
    for i, r in enumerate(rows):
        pd.DataFrame([r], columns=cols).to_parquet(f"{tmpdir_run}/late/p{i}.parquet", index=False)
    schema = spark.createDataFrame([rows[0]], cols).schema
    for late in ("reference", "no_decay"):
        st = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_run}/late")
        out = _collect_stream(spark, RS.stream_relation_scores(st, lam=8e-10, late=late),
                              f"{tmpdir_run}/ck_{late}", f"late_{late}").sort_values("k1")
        second = out.iloc[1]
        if late == "no_decay":
            assert abs(second["raw_score"] - 0.03) < 1e-12
        else:
            import math
            f = math.exp(8e-10 * 50 * 86400000)  # dt < 0 amplifies
            assert abs(second["raw_score"] - (min(0.01 * f, 100.0) + 0.02)) < 1e-9


def test_latest_state_table_idempotent(spark, tmpdir_run):
    t = LatestStateTable(spark, f"{tmpdir_run}/latest")
    b1 = spark.createDataFrame([("B", "A", 1, 0.5), ("B", "A", 2, 0.7), ("C", "A", 1, 0.1)],
                               "actor1 string, actor2 string, ts long, score double")
    t.upsert(b1, 0)
    b2 = spark.createDataFrame([("C", "A", 5, 0.9)], "actor1 string, actor2 string, ts long, score double")
    t.upsert(b2, 1)
    t.upsert(b1, 1)  # replay of a committed batch id: no-op
    got = {(r.actor1, r.actor2): r.score for r in t.read().collect()}
    assert got == {("B", "A"): 0.7, ("C", "A"): 0.9}


def test_messages_json(spark):
    feed = spark.createDataFrame([("B", "A", 0.25)], "actor1 string, actor2 string, score double")
    assert change_messages(feed).first().value == '{"actor1":"B","actor2":"A","score":0.25}'
    snap = feed.withColumn("request_ts", F.lit(1))
    assert snapshot_messages(snap).first().value == '[{"_1":"B","_2":"A","_3":0.25}]'


def test_latest_state_table_compaction(spark, tmpdir_run):
    t = LatestStateTable(spark, f"{tmpdir_run}/latest2", compact_every=3)
    for b in range(7):
        t.upsert(spark.createDataFrame([("B", "A", b, float(b)), (f"K{b}", "A", b, -1.0)],
                                       "actor1 string, actor2 string, ts long, score double"), b)
    got = {(r.actor1, r.actor2): r.score for r in t.read().collect()}
    assert got[("B", "A")] == 6.0 and len(got) == 8
    p = t._read_pointer()
    assert p["base"] == 5 and p["deltas"] == [6]


def test_vectorised_stream_fold_equals_loop():
    import numpy as np
    from relflow.streaming.relation_state import RelationScoreProcessor
    rng = np.random.default_rng(9)
    for late in ("reference", "no_decay"):
        p = RelationScoreProcessor(1e-8, 3.0, late, "ts", "score", [], [])
        ts = rng.integers(0, 10**9, 200)           # unsorted: late rows included
        xs = rng.choice([0.5, -0.5, 1.0, -2.0], 200)
        fast = p._fold_vectorised(ts, xs, 0.7, 1.5, int(ts[0]) + 5)
        slow = p._fold_loop(ts, xs, 0.7, 1.5, int(ts[0]) + 5)
        assert fast is not None
        assert np.allclose(fast[0], slow[0], atol=1e-9) and np.allclose(fast[1], slow[1], atol=1e-9)
        assert fast[2][2] == slow[2][2]
