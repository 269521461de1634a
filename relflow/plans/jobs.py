"""End-to-end jobs: the relation-score and interaction-count applications.

Batch: event files -> both actors -> last-seen day -> unordered pair ->
quad score -> relation state / change feed -> files. Stream: the same chain
as Structured Streaming queries whose micro-batches write the change messages
and upsert the latest-state table (``foreachBatch``), with snapshot requests
answered from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.operators import interactions as B
from relflow.operators import state as C
from relflow.sinks.history import ChangeHistory
from relflow.sinks.writers import LatestStateTable, change_messages
from relflow.sources.events import read_events, stream_events
from relflow.streaming import relation_state as RS
from relflow.streaming.sessions import stream_snapshots

EVENT_ID_ORDER = ("globalEventID",)


def _events_with_order(events: DataFrame) -> DataFrame:
    # the event id orders events of the same day; the file name partitions the
    # last-seen-day fill (as one reader task per file would)
    return events.withColumn("source", F.input_file_name())


def relation_scores_batch(spark: SparkSession, events_path: str, out_path: str | None = None,
                          lam: float = C.DEFAULT_LAMBDA, feed: bool = False) -> DataFrame:
    """Relation scores of an event-file folder: the state per pair (default) or
    the change feed; written as parquet when ``out_path`` is given."""
    ev = _events_with_order(read_events(spark, events_path))
    sig = B.signed_interactions(ev, order_cols=EVENT_ID_ORDER)
    res = (C.relation_scores_feed(sig, lam=lam, order=EVENT_ID_ORDER) if feed
           else C.relation_scores(sig, lam=lam, order=EVENT_ID_ORDER))
    if out_path:
        res.write.mode("overwrite").parquet(out_path)
    return res


def interaction_counts_batch(spark: SparkSession, events_path: str) -> DataFrame:
    """Interaction count per unordered pair of an event-file folder."""
    ev = B.canonical_pair(B.with_both_actors(read_events(spark, events_path)))
    return C.interaction_counts(ev)


class StreamJob:
    """A chain of streaming queries, each reading what the one before writes.
    With an ``availableNow`` trigger they run one after the other."""

    def __init__(self, starts, in_turn: bool):
        self._starts, self._in_turn = list(starts), in_turn
        self.queries = [] if in_turn else [s() for s in self._starts]
        if in_turn:
            self.queries.append(self._starts[0]())

    def awaitTermination(self, timeout: float | None = None) -> None:
        self.queries[0].awaitTermination(timeout)
        for start in self._starts[len(self.queries):] if self._in_turn else []:
            self.queries.append(start())
            self.queries[-1].awaitTermination(timeout)
        for q in self.queries[1:]:
            q.awaitTermination(timeout)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def _resolve_days(events: DataFrame, resolved_path: str, checkpoint: str, trigger: dict):
    """Last-seen-day fill (B5) of a stream: every micro-batch goes through the
    ordered scan, per source, after the last day that earlier batches saw of the
    source. Only sources of the micro-batch bring their last day, however many were
    seen before. Rows with their time are written beside ``resolved_path`` and moved as a
    whole to ``resolved_path/batch=<id>``, so that its readers never see an attempt that
    died; the last days are kept beside it. A batch that is replayed after its rows
    were moved leaves them as they are."""
    spark = events.sparkSession
    days = LatestStateTable(spark, f"{resolved_path}_days", keys=("source",), order=EVENT_ID_ORDER)
    keep = [B.A1, B.A2, "quadClass", "day"]
    names = ["source", *EVENT_ID_ORDER, *keep]

    def publish(rows: DataFrame, batch_id: int, out: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        target = path(out)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            return
        staged = f"{resolved_path}_staged/batch={batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        fs.mkdirs(target.getParent())
        if not fs.rename(path(staged), target):
            raise OSError(f"cannot move {staged} to {out}")

    def run(batch: DataFrame, batch_id: int) -> None:
        out = f"{resolved_path}/batch={batch_id}"
        if days.current_batch() is not None and batch_id <= days.current_batch():
            return
        rows = B.with_both_actors(batch).select(*names).withColumn("_old", F.lit(False))
        seen = days.read()
        if seen is not None:
            # the source's last day, as a row before all others
            kinds = dict(rows.dtypes)
            old = seen.join(rows.select("source").distinct(), "source", "left_semi").select("source", F.lit(None).cast(kinds["globalEventID"]).alias("globalEventID"),
                              *[F.lit(None).cast(kinds[c]).alias(c) for c in keep if c != "day"],
                              F.timestamp_millis("ts").cast("date").alias("day"), F.lit(True).alias("_old"))
            rows = rows.unionByName(old)
        rows = rows.withColumn("_new", F.when(F.col("_old"), 0).otherwise(1))
        filled = B.event_time_locf(rows, order_cols=("_new", *EVENT_ID_ORDER), keep=[B.A1, B.A2, "quadClass", "day", "_old"])
        publish(filled.filter(~F.col("_old")).drop("_old", "_new"), batch_id, out)
        written = spark.read.parquet(out)
        days.upsert(written.filter(F.col("day").isNotNull()).select("source", *EVENT_ID_ORDER, "ts"), batch_id)

    return (events.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/days").trigger(**trigger)
            if trigger else events.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/days")).start()


def _signed_stream(spark: SparkSession, resolved_path: str, max_files_per_trigger: int | None) -> DataFrame:
    """The resolved rows as a stream, signed and paired."""
    schema = (f"source string, globalEventID {_event_id_type()}, {B.A1} string, {B.A2} string, quadClass int, day date, ts long")
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(resolved_path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(resolved_path))
    return B.quad_score(B.canonical_pair(r.parquet(resolved_path)))


def _event_id_type() -> str:
    from relflow.sources.events import event_schema
    return event_schema()["globalEventID"].dataType.simpleString()


def relation_scores_stream(spark: SparkSession, events_path: str, changes_path: str, state_path: str,
                           checkpoint: str, lam: float = C.DEFAULT_LAMBDA, late: str = "reference",
                           max_files_per_trigger: int | None = None, trigger: dict | None = None,
                           requests: DataFrame | None = None, snapshots_path: str | None = None):
    """Streaming relation scores, in two queries. The first fills in the last-seen
    day (``<state_path>_resolved``). The second keeps the scores: per micro-batch,
    the change messages (JSON) go to ``changes_path/batch=<id>`` and the latest
    state per pair is upserted into ``state_path`` (``LatestStateTable``). With
    ``requests`` (``stream_snapshot_requests``), the changes are also kept in
    ``<state_path>_history`` and a third query answers each request with the state as
    of its time, raw scores as rows in ``snapshots_path``. Returns ``(job, table)``."""
    history = ChangeHistory(spark, f"{state_path}_history", order=EVENT_ID_ORDER) if requests is not None else None
    table = LatestStateTable(spark, state_path, keys=("actor1", "actor2"), order=("ts",) + EVENT_ID_ORDER)
    resolved = f"{state_path}_resolved"

    def days():
        ev = stream_events(spark, events_path, max_files_per_trigger).withColumn("source", F.input_file_name())
        return _resolve_days(ev, resolved, checkpoint, trigger or {})

    def scores():
        changes = RS.stream_relation_scores(_signed_stream(spark, resolved, None), lam=lam, late=late, order=EVENT_ID_ORDER)

        def run(batch: DataFrame, batch_id: int) -> None:
            if table.current_batch() is not None and batch_id <= table.current_batch():
                return
            b = batch.checkpoint()
            change_messages(b).write.mode("overwrite").text(f"{changes_path}/batch={batch_id}")
            if history is not None:
                history.append(b, batch_id)
            table.upsert(b.select("actor1", "actor2", "ts", *EVENT_ID_ORDER, "raw_score", "norm", "score"), batch_id)

        return _started(changes, run, f"{checkpoint}/scores", trigger)

    return _job([days, scores], requests, history, snapshots_path, checkpoint, "raw_score", trigger), table


def interaction_counts_stream(spark: SparkSession, events_path: str, changes_path: str, state_path: str,
                              checkpoint: str, max_files_per_trigger: int | None = None, trigger: dict | None = None,
                              requests: DataFrame | None = None, snapshots_path: str | None = None):
    """Streaming interaction counts: change messages, latest state and snapshots
    on request, as ``relation_scores_stream`` has them for scores."""
    table = LatestStateTable(spark, state_path, keys=("actor1", "actor2"), order=("n",))

    def counts():
        ev = B.canonical_pair(B.with_both_actors(stream_events(spark, events_path, max_files_per_trigger)))
        feed = RS.stream_counts(ev, order=EVENT_ID_ORDER)

        def run(batch: DataFrame, batch_id: int) -> None:
            if table.current_batch() is not None and batch_id <= table.current_batch():
                return
            b = batch.checkpoint()
            change_messages(b, "n").write.mode("overwrite").text(f"{changes_path}/batch={batch_id}")
            table.upsert(b.select("actor1", "actor2", *EVENT_ID_ORDER, "n"), batch_id)

        return _started(feed, run, f"{checkpoint}/counts", trigger)

    return _job([counts], requests, table, snapshots_path, checkpoint, "n", trigger), table


def _started(df: DataFrame, run, checkpoint: str, trigger: dict | None):
    w = df.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def _job(starts: list, requests, table, snapshots_path, checkpoint, value, trigger) -> StreamJob:
    if requests is not None:
        starts = [*starts, lambda: stream_snapshots(requests, table, snapshots_path, f"{checkpoint}/snapshots", value, trigger)]
    return StreamJob(starts, in_turn=bool(trigger and trigger.get("availableNow")))
