"""Session stream (G12), snapshot stream (C10), event / request sources (A2, A5), model text."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from relflow.operators import evaluation as G
from relflow.sinks.writers import LatestStateTable, model_text, write_model, write_model_stream
from relflow.sources.events import event_columns, stream_events
from relflow.sources.ratings import stream_snapshot_requests
from relflow.streaming.sessions import stream_daily_ndcg_sessions, stream_snapshots


def test_session_stream_equals_batch_for_closed_sessions(spark, tmpdir_run):
    rng = np.random.default_rng(4)
    t = np.sort(np.concatenate([rng.integers(0, 50, 300), rng.integers(200, 260, 300), rng.integers(400, 900, 400)]))
    pdf = pd.DataFrame({"t": t, "ts": t * 3000, "ndcg": rng.random(len(t))})
    os.makedirs(f"{tmpdir_run}/ev")
    for i, part in enumerate(np.array_split(pdf, 5)):
        part.to_parquet(f"{tmpdir_run}/ev/p{i}.parquet", index=False)
    schema = spark.createDataFrame(pdf.head(1)).schema
    st = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_run}/ev")
    q = stream_daily_ndcg_sessions(st, 20, f"{tmpdir_run}/state", f"{tmpdir_run}/out", f"{tmpdir_run}/ck",
                                   trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(f"{tmpdir_run}/out").toPandas()
    batch = G.daily_ndcg_sessions(spark.createDataFrame(pdf), 20).toPandas()
    last_start = batch.session_start.max()       # the open session is not emitted yet
    exp = batch[batch.session_start < last_start]
    key = ["session_start", "day"]
    m = got.merge(exp, on=key, suffixes=("_s", "_b"))
    assert len(got) == len(exp) == len(m)
    assert (m.n_s == m.n_b).all() and np.allclose(m.mean_ndcg_s, m.mean_ndcg_b)


def test_snapshot_stream_and_requests_source(spark, tmpdir_run):
    table = LatestStateTable(spark, f"{tmpdir_run}/latest")
    table.upsert(spark.createDataFrame([("B", "A", 1, 0.5), ("C", "A", 2, -0.1)],
                                       "actor1 string, actor2 string, ts long, score double"), 0)
    os.makedirs(f"{tmpdir_run}/req")
    with open(f"{tmpdir_run}/req/a.txt", "w") as f:
        f.write("yes\nno\nyes\n")
    req = stream_snapshot_requests(spark, fmt="text", path=f"{tmpdir_run}/req")
    q = stream_snapshots(req, table, f"{tmpdir_run}/snap", f"{tmpdir_run}/ck", value="score", trigger={"availableNow": True})
    q.awaitTermination()
    out = spark.read.parquet(f"{tmpdir_run}/snap").toPandas()
    # "no" is ignored; each distinct request time gets the whole committed state
    n_req = out.request_ts.nunique()
    assert n_req >= 1 and len(out) == 2 * n_req
    assert sorted(set(zip(out.actor1, out.score))) == [("B", 0.5), ("C", -0.1)]


def test_stream_events_source(spark, tmpdir_run):
    os.makedirs(f"{tmpdir_run}/ev")
    line = "\t".join({"globalEventID": "7", "day": "20170328", "actor1Code_countryCode": "USA",
                      "actor2Code_countryCode": "FRA", "quadClass": "2"}.get(n, "") for n, _ in event_columns())
    with open(f"{tmpdir_run}/ev/a.tsv", "w") as f:
        f.write(line + "\n")
    st = stream_events(spark, f"{tmpdir_run}/ev", max_files_per_trigger=1)
    q = st.writeStream.format("memory").queryName("ev_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("SELECT * FROM ev_stream").collect()
    assert len(r) == 1 and r[0].globalEventID == 7 and r[0].quadClass == 2


def test_model_text_and_writers(spark, tmpdir_run):
    upd = spark.createDataFrame([(1, [0.5, 1e-4], 1), (1, [0.25, 2.0], 2), (3, [1.0, -1.0], 1)],
                                "id long, factors array<double>, step long")
    write_model(upd, f"{tmpdir_run}/model")
    lines = sorted(r.value for r in spark.read.text(f"{tmpdir_run}/model").collect())
    assert lines == ["1:0.25,2.0", "3:1.0,-1.0"]
    assert model_text(upd.limit(1)).first().value in ("1:0.5,1.0E-4", "1:0.25,2.0", "3:1.0,-1.0")
    os.makedirs(f"{tmpdir_run}/src")
    upd.toPandas().to_parquet(f"{tmpdir_run}/src/u.parquet", index=False)
    st = spark.readStream.schema(upd.schema).parquet(f"{tmpdir_run}/src")
    q = write_model_stream(st, f"{tmpdir_run}/mstream", f"{tmpdir_run}/ck2", trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.text(f"{tmpdir_run}/mstream").count() == 3


def test_change_messages_stream_sink(spark, tmpdir_run):
    from relflow.sinks.writers import write_changes
    os.makedirs(f"{tmpdir_run}/feed")
    pd.DataFrame({"actor1": ["B", "C"], "actor2": ["A", "A"], "score": [0.5, -0.25]}) \
        .to_parquet(f"{tmpdir_run}/feed/f.parquet", index=False)
    st = spark.readStream.schema("actor1 string, actor2 string, score double").parquet(f"{tmpdir_run}/feed")
    q = write_changes(st, f"{tmpdir_run}/msgs", checkpoint=f"{tmpdir_run}/ck", trigger={"availableNow": True})
    q.awaitTermination()
    got = sorted(r.value for r in spark.read.text(f"{tmpdir_run}/msgs").collect())
    assert got == ['{"actor1":"B","actor2":"A","score":0.5}', '{"actor1":"C","actor2":"A","score":-0.25}']


def test_state_table_survives_a_stop_between_its_pointer_steps(spark, tmpdir_run, monkeypatch):
    rows = spark.createDataFrame([("B", "A", 1, 0.5)], "actor1 string, actor2 string, ts long, score double")
    newer = spark.createDataFrame([("B", "A", 2, 0.7)], rows.schema)
    table = LatestStateTable(spark, f"{tmpdir_run}/latest", compact_every=2)
    table.upsert(rows, 0)
    with monkeypatch.context() as m:
        m.setattr(LatestStateTable, "_write_pointer", lambda self, obj: (_ for _ in ()).throw(OSError("stopped")))
        try:
            table.upsert(newer, 1)
        except OSError:
            pass
    again = LatestStateTable(spark, f"{tmpdir_run}/latest", compact_every=2)
    assert again.current_batch() == 0 and [r.score for r in again.read().collect()] == [0.5]
    reader = again.read()           # looked up before the next versions
    again.upsert(newer, 1)          # the replayed batch, with a compaction
    assert [r.score for r in again.read().collect()] == [0.7]
    assert [r.score for r in reader.collect()] == [0.5]     # its files are still there
    for i in range(2, 7):
        again.upsert(newer.withColumn("score", F.lit(float(i))), i)
    assert [r.score for r in again.read().collect()] == [6.0]
    names = os.listdir(f"{tmpdir_run}/latest")
    assert sum(n.startswith("_current.") for n in names) == 2 and sum(n.startswith("base=") for n in names) <= 2
