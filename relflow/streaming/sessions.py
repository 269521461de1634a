"""Streaming forms of the session aggregate (G12) and of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.operators import evaluation as G
from relflow.session import scan_partitions
from relflow.sinks.history import ChangeHistory
from relflow.sinks.writers import LatestStateTable


class _Versioned:
    """Parquet versions ``v=<batch_id>`` plus a JSON pointer (Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str):
        self.t = LatestStateTable(spark, path)

    def pointer(self):
        return self.t._read_pointer()

    def commit(self, df: DataFrame | None, batch_id: int, meta: dict):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{self.t.path}/v={batch_id}")
        self.t._write_pointer(dict(meta, batch_id=int(batch_id), has_data=df is not None))

    def read(self, p):
        if not p or p.get("data_batch") is None:
            return None
        return self.t.spark.read.parquet(f"{self.t.path}/v={p['data_batch']}")


def stream_daily_ndcg_sessions(evals: DataFrame, gap: int, state_path: str, out_path: str, checkpoint: str,
                               time_col: str = "t", ts_col: str = "ts", value: str = "ndcg",
                               trigger: dict | None = None):
    """G12 as a stream. Per micro-batch: reduce to ``(t, day, n, s)``, merge
    with the reduced rows of the still-open sessions (a versioned table),
    sessionise, emit the sessions closed by the watermark (``max t - gap``)
    to ``out_path/batch=<id>`` and keep only the open ones. State is the open
    sessions' distinct ``(t, day)`` rows - never a session's raw rows."""
    spark = evals.sparkSession
    state = _Versioned(spark, state_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        p = state.pointer()
        if p is not None and batch_id <= p["batch_id"]:
            return
        red = G.reduce_evals(batch, time_col, ts_col, value)
        old = state.read(p)
        allr = red if old is None else old.unionByName(red)
        allr = allr.groupBy("_t", "day").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).checkpoint()
        max_t = allr.agg(F.max("_t")).first()[0]
        if max_t is None:
            state.commit(None, batch_id, {"data_batch": p.get("data_batch") if p else None})
            return
        agg = G.session_day_aggregates(allr, gap).checkpoint()
        closed = agg.filter(F.col("session_end") < F.lit(max_t - gap))
        closed.select("session_start", "day", "n", (F.col("s") / F.col("n")).alias("mean_ndcg")) \
              .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        open_start = agg.filter(F.col("session_end") >= F.lit(max_t - gap)).agg(F.min("session_start")).first()[0]
        keep = allr.filter(F.col("_t") >= F.lit(open_start)) if open_start is not None else allr.limit(0)
        state.commit(keep, batch_id, {"data_batch": batch_id})

    w = evals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def stream_snapshots(requests: DataFrame, table: LatestStateTable, out_path: str, checkpoint: str,
                     value: str = "raw_score", trigger: dict | None = None):
    """C10 as a stream: each snapshot request of a micro-batch gets the full pair
    state, written as rows ``request_ts, actor1, actor2, value`` to
    ``out_path/batch=<id>``. From a ``ChangeHistory`` that is the state as of the
    request's own time, from the changes committed when the batch runs; from a
    ``LatestStateTable`` (fed by ``upsert_latest``) the state committed at that moment.
    A request that finds no state gets one row without a pair, which
    ``snapshot_messages`` turns into an empty array. ``value``: the raw score,
    as the reference sends it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        times = batch.select("request_ts").where("request_ts IS NOT NULL").distinct().checkpoint()
        reqs = times.select(F.unix_millis(F.col("request_ts").cast("timestamp")).alias("request_ts")).distinct()
        if isinstance(table, ChangeHistory):
            found = table.as_of(times)
        else:
            found = _of_every_request(reqs, table.read(), value)
        found = found.select("request_ts", "actor1", "actor2", value)
        written = f"{out_path}/batch={batch_id}"
        found.write.mode("overwrite").parquet(written)
        answered = reqs.sparkSession.read.schema(found.schema).parquet(written).select("request_ts").distinct()
        none = reqs.join(answered, "request_ts", "left_anti").select(
            "request_ts", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("actor1", "actor2", value)])
        none.checkpoint().write.mode("append").parquet(written)

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def _of_every_request(reqs: DataFrame, state: DataFrame | None, value: str) -> DataFrame:
    """Each state row once for each request. The state is dealt to parts by its keys and
    every part meets the requests in an equi-join, so no side is broadcast unseen."""
    if state is None:
        return reqs.select("request_ts", *[F.lit(None).cast("string").alias(c) for c in ("actor1", "actor2")],
                           F.lit(None).cast("double").alias(value)).limit(0)
    n = scan_partitions(reqs.sparkSession)
    dealt = state.select("actor1", "actor2", value, F.pmod(F.xxhash64("actor1", "actor2"), F.lit(n)).alias("_part"))
    return reqs.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(dealt, "_part")
