"""End-to-end jobs on hand-made event files."""

import os

from relflow.plans import jobs
from relflow.sources.events import event_columns


def _write_events(path, rows, name="events.csv"):
    os.makedirs(path, exist_ok=True)
    lines = []
    for gid, day, a1, a2, quad in rows:
        vals = {"globalEventID": str(gid), "day": day, "actor1Code_countryCode": a1,
                "actor2Code_countryCode": a2, "quadClass": str(quad), "dateAdded": day}
        lines.append("\t".join(vals.get(n, "") for n, _ in event_columns()))
    with open(f"{path}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


ROWS = [(1, "20170301", "USA", "FRA", 1), (2, "20170302", "FRA", "USA", 2), (3, "", "USA", "FRA", 3),
        (4, "20170305", "DEU", "", 1), (5, "20170310", "DEU", "FRA", 4), (6, "20170311", "USA", "FRA", 9)]


def test_batch_relation_job(spark, tmpdir_run):
    _write_events(f"{tmpdir_run}/ev", ROWS)
    st = {(r.actor1, r.actor2): r for r in jobs.relation_scores_batch(spark, f"{tmpdir_run}/ev").collect()}
    assert set(st) == {("USA", "FRA"), ("FRA", "DEU")}
    assert st[("USA", "FRA")].n == 3          # event 6 has an unknown class; event 4 lacks an actor
    import math
    d1 = 86400000
    s = 0.01
    s = s * math.exp(-8e-10 * d1) + 0.02      # day 2
    s = s * 1.0 + (-0.01)                     # null day: reuses day 2
    assert abs(st[("USA", "FRA")].raw_score - s) < 1e-12
    counts = {(r.actor1, r.actor2): r.n for r in jobs.interaction_counts_batch(spark, f"{tmpdir_run}/ev").collect()}
    assert counts[("USA", "FRA")] == 4


def _stream(spark, d, rows_by_file, mft):
    for i, rows in enumerate(rows_by_file):
        _write_events(f"{d}/ev", rows, f"e{i}.csv")
    job, table = jobs.relation_scores_stream(spark, f"{d}/ev", f"{d}/changes", f"{d}/state", f"{d}/ck",
                                             trigger={"availableNow": True}, max_files_per_trigger=mft)
    job.awaitTermination()
    return {(r.actor1, r.actor2): r for r in table.read().collect()}


def test_stream_relation_job_equals_batch(spark, tmpdir_run):
    st = _stream(spark, tmpdir_run, [ROWS], None)
    batch = {(r.actor1, r.actor2): r for r in jobs.relation_scores_batch(spark, f"{tmpdir_run}/ev").collect()}
    assert set(st) == set(batch) == {("USA", "FRA"), ("FRA", "DEU")}
    for k in st:
        assert abs(st[k].raw_score - batch[k].raw_score) < 1e-12 and abs(st[k].norm - batch[k].norm) < 1e-12
    assert spark.read.text(f"{tmpdir_run}/changes").count() == 4


def test_null_days_across_files_and_batches(spark, tmpdir_run):
    # a file a micro-batch; the second file starts without a day, the first never lacks one before it has seen one
    files = [[(1, "20170301", "USA", "FRA", 1), (2, "", "FRA", "USA", 2)], [(3, "", "USA", "FRA", 3), (4, "20170410", "USA", "FRA", 1)]]
    st = _stream(spark, tmpdir_run, files, 1)
    batch = {(r.actor1, r.actor2): r for r in jobs.relation_scores_batch(spark, f"{tmpdir_run}/ev").collect()}
    for k in batch:
        assert abs(st[k].raw_score - batch[k].raw_score) < 1e-12 and abs(st[k].norm - batch[k].norm) < 1e-12


def test_last_days_carry_over_to_later_batches_of_a_source(spark, tmpdir_run):
    from pyspark.sql import functions as F
    from relflow.sources.events import event_columns
    _write_events(f"{tmpdir_run}/in", ROWS[:2], "a.csv")
    _write_events(f"{tmpdir_run}/in", [(3, "", "USA", "FRA", 3), (4, "20170305", "USA", "FRA", 1)], "b.csv")
    ev = jobs.stream_events(spark, f"{tmpdir_run}/in", 1).withColumn("source", F.lit("one feed"))
    jobs._resolve_days(ev, f"{tmpdir_run}/resolved", f"{tmpdir_run}/ck", {"availableNow": True}).awaitTermination()
    got = {r.globalEventID: r.ts for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmpdir_run}/resolved").collect()}
    day = 86400000
    assert got == {1: 17226 * day, 2: 17227 * day, 3: 17227 * day, 4: 17230 * day}
    assert event_columns()


def test_only_sources_of_a_batch_bring_their_last_day(spark, tmpdir_run, monkeypatch):
    from pyspark.sql import functions as F
    carried = []
    fill = jobs.B.event_time_locf
    monkeypatch.setattr(jobs.B, "event_time_locf", lambda rows, **kw: (carried.append(rows.where("_old").count()), fill(rows, **kw))[1])
    for i in range(4):
        _write_events(f"{tmpdir_run}/in", [(2 * i + 1, "20170301", "USA", "FRA", 1), (2 * i + 2, "", "USA", "FRA", 1)], f"{i}.csv")
    ev = jobs.stream_events(spark, f"{tmpdir_run}/in", 1).withColumn("source", F.input_file_name())
    jobs._resolve_days(ev, f"{tmpdir_run}/resolved", f"{tmpdir_run}/ck", {"availableNow": True}).awaitTermination()
    assert carried == [0, 0, 0, 0]
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmpdir_run}/resolved").count() == 8


def test_an_attempt_that_died_is_not_seen_and_not_counted(spark, tmpdir_run):
    from pyspark.sql import functions as F
    _write_events(f"{tmpdir_run}/in", ROWS[:2], "a.csv")
    # rows of an attempt that died while it wrote: beside the folder that readers list
    spark.range(5).write.parquet(f"{tmpdir_run}/resolved_staged/batch=0/half")
    ev = jobs.stream_events(spark, f"{tmpdir_run}/in", 1).withColumn("source", F.lit("feed"))
    jobs._resolve_days(ev, f"{tmpdir_run}/resolved", f"{tmpdir_run}/ck", {"availableNow": True}).awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmpdir_run}/resolved")
    assert sorted(r.globalEventID for r in out.collect()) == [1, 2]
    assert os.listdir(f"{tmpdir_run}/resolved_staged") == []


def test_stream_counts_job_with_snapshots(spark, tmpdir_run):
    from relflow.sinks.writers import snapshot_messages
    from relflow.sources.ratings import stream_snapshot_requests
    _write_events(f"{tmpdir_run}/ev", ROWS[:3], "a.csv")
    _write_events(f"{tmpdir_run}/ev", ROWS[3:], "b.csv")
    os.makedirs(f"{tmpdir_run}/req")
    with open(f"{tmpdir_run}/req/a.txt", "w") as f:
        f.write("yes\n")
    req = stream_snapshot_requests(spark, fmt="text", path=f"{tmpdir_run}/req")
    job, table = jobs.interaction_counts_stream(spark, f"{tmpdir_run}/ev", f"{tmpdir_run}/changes", f"{tmpdir_run}/state", f"{tmpdir_run}/ck",
                                                1, {"availableNow": True}, req, f"{tmpdir_run}/snap")
    job.awaitTermination()
    want = {(r.actor1, r.actor2): r.n for r in jobs.interaction_counts_batch(spark, f"{tmpdir_run}/ev").collect()}
    assert {(r.actor1, r.actor2): r.n for r in table.read().collect()} == want
    snap = spark.read.parquet(f"{tmpdir_run}/snap")
    assert {(r.actor1, r.actor2): r.n for r in snap.collect()} == want
    assert snapshot_messages(snap, "n").count() == 1
    # a request before any state gets an empty array
    from relflow.sinks.writers import LatestStateTable
    from relflow.streaming.sessions import stream_snapshots
    none = LatestStateTable(spark, f"{tmpdir_run}/nothing")
    stream_snapshots(req, none, f"{tmpdir_run}/snap0", f"{tmpdir_run}/ck0", trigger={"availableNow": True}).awaitTermination()
    assert [r.value for r in snapshot_messages(spark.read.parquet(f"{tmpdir_run}/snap0"), "raw_score").collect()] == ["[]"]


def test_stream_runs_from_any_folder(tmpdir_run):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    _write_events(f"{tmpdir_run}/ev", ROWS)
    code = f"""
import sys; sys.path.insert(0, {root!r})
from relflow.plans import jobs
from relflow.session import get_spark
job, table = jobs.relation_scores_stream(get_spark("local[2]", 2), "{tmpdir_run}/ev", "{tmpdir_run}/changes", "{tmpdir_run}/state",
                                         "{tmpdir_run}/ck", trigger={{"availableNow": True}})
job.awaitTermination()
print("PAIRS", table.read().count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"RELFLOW_DRIVER_MEMORY": "2g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmpdir_run, env=env, capture_output=True, text=True, timeout=300)
    assert "PAIRS 2" in out.stdout, out.stderr[-2000:]
