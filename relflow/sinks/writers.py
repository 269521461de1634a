"""Sinks: change and snapshot messages, latest-state table, model text."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.plans.ordered_scan import Channel, ordered_scan

# ------------------------------------------------------------ messages

def change_messages(feed: DataFrame, value: str = "score") -> DataFrame:
    """One JSON object ``{"actor1","actor2","score"}`` per change."""
    return feed.select(F.to_json(F.struct(F.col("actor1"), F.col("actor2"),
                                          F.col(value).alias("score"))).alias("value"))


def snapshot_messages(snap: DataFrame, value: str = "score", request_col: str = "request_ts",
                      parts: int = 1) -> DataFrame:
    """One JSON array of ``{"_1","_2","_3"}`` per request (E2). ``parts > 1``
    splits each snapshot over that many messages by pair hash, bounding the
    size of one message (and of one aggregation group)."""
    item = F.struct(F.col("actor1").alias("_1"), F.col("actor2").alias("_2"), F.col(value).alias("_3"))
    keys = [F.col(request_col)]
    if parts > 1:
        keys.append(F.pmod(F.hash("actor1", "actor2"), F.lit(parts)).alias("part"))
    item = F.when(F.col("actor1").isNotNull(), item)     # a row without a pair stands for an empty snapshot
    return snap.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("value"))


def bounded_snapshot_messages(snap: DataFrame, value: str = "score", request_col: str = "request_ts",
                              max_bytes: int = 1 << 20) -> DataFrame:
    """``(request, part, value)``: each snapshot as arrays of about ``max_bytes`` (a
    pair that is larger gets an array of its own), in the order of ``snapshot_messages``:
    the arrays of a request, one after another, hold the elements of its one array.
    The bytes before a pair in its snapshot come from an ordered scan, so one request
    of all pairs spreads over tasks, and no group is larger than a message."""
    item = F.struct(F.col("actor1").alias("_1"), F.col("actor2").alias("_2"), F.col(value).alias("_3"))
    item = F.when(F.col("actor1").isNotNull(), item)
    rows = snap.select(F.col(request_col), F.col("actor1").alias("_a"), F.col("actor2").alias("_b"), F.to_json(item).alias("_json"))
    rows = rows.withColumn("_size", F.coalesce(F.octet_length("_json") + 1, F.lit(0)).cast("double"))
    sized = ordered_scan(rows, [request_col], ["_a", "_b"], [Channel("_upto", a=F.lit(1.0), b=F.col("_size"))], keep=["_json", "_size"])
    part = F.floor((F.col("_upto") - F.col("_size")) / F.lit(float(max_bytes)))
    lists = sized.groupBy(F.col(request_col), part.alias("part")).agg(
        F.array_sort(F.collect_list(F.when(F.col("_json").isNotNull(), F.struct("_a", "_b", "_json")))).alias("_l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda s: s["_json"]), ","), F.lit("]"))
    return lists.select(request_col, "part", text.alias("value"))


def write_messages(msgs: DataFrame, path: str | None = None, fmt: str = "text", options: dict | None = None,
                   checkpoint: str | None = None, trigger: dict | None = None):
    """Write a ``value`` column as text files (batch) or to any stream sink,
    e.g. ``fmt="kafka"`` with ``topic`` / bootstrap options (E1, E2).
    Returns the started query for streams."""
    if msgs.isStreaming:
        w = msgs.writeStream.format(fmt).outputMode("append")
        for k, v in (options or {}).items():
            w = w.option(k, v)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        if trigger:
            w = w.trigger(**trigger)
        return w.start(path) if path else w.start()
    w = msgs.write.mode("overwrite")
    if fmt == "text":
        w.text(path)
    else:
        w.format(fmt).options(**(options or {})).save(path)
    return None


def write_changes(feed: DataFrame, path: str | None = None, value: str = "score", **kw):
    return write_messages(change_messages(feed, value), path, **kw)


def write_snapshots(snap: DataFrame, path: str | None = None, value: str = "score", parts: int = 1, **kw):
    return write_messages(snapshot_messages(snap, value, parts=parts).select("value"), path, **kw)


# ------------------------------------------------------ latest state

class LatestStateTable:
    """Last value per key, replaceable as a whole.

    Storage: a compacted base version plus delta versions, parquet folders
    under ``path``; the newest file ``_current.<number>`` names them. ``upsert(changes,
    batch_id)`` writes only the last change per key of that batch
    (``max_by`` over ``order``) as a new delta, so a micro-batch costs its own
    size, not the state's; every ``compact_every`` batches the deltas are
    folded into a new base. ``read()`` resolves the newest version of each key
    (newer batch wins). Re-running a committed batch id is a no-op, so a
    ``foreachBatch`` retry after a failure is idempotent.
    """

    def __init__(self, spark: SparkSession, path: str, keys=("actor1", "actor2"), order=("ts",),
                 compact_every: int = 16):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), list(order)
        self.compact_every = compact_every

    # pointer file through the Hadoop file system, so any shared store works
    def _hfs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf), jvm

    def _pointers(self):
        """Numbers of the pointer files ``_current.<number>``, ascending."""
        fs, jvm = self._hfs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split(".")[1]) for n in names if n.startswith("_current.") and n.split(".")[1].isdigit())

    def _read_pointer(self):
        fs, jvm = self._hfs()
        have = self._pointers()
        if not have:
            return None
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current.{have[-1]}"))
        try:
            data = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(data)

    def _write_pointer(self, obj):
        """A new pointer file under the next number, whole at once by a rename; the
        newest number counts, so there is a valid pointer at every moment. The
        one before stays for readers that have just looked."""
        fs, jvm = self._hfs()
        path = jvm.org.apache.hadoop.fs.Path
        have = self._pointers()
        tmp = path(self.path + "/_tmp_current")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(obj).encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(tmp, path(f"{self.path}/_current.{(have[-1] if have else 0) + 1}")):
            raise OSError(f"could not write the pointer of {self.path}")
        for n in have[:-1]:
            fs.delete(path(f"{self.path}/_current.{n}"), False)

    def current_batch(self):
        p = self._read_pointer()
        return None if p is None else p["batch_id"]

    def _resolve(self, p) -> DataFrame | None:
        dirs = ([f"{self.path}/base={p['base']}"] if p.get("base") is not None else []) + \
               [f"{self.path}/v={b}" for b in p.get("deltas", [])]
        if not dirs:
            return None
        allv = self.spark.read.parquet(*dirs)
        if len(dirs) == 1:
            return allv.drop("_v")
        cols = [c for c in allv.columns if c != "_v"]
        return allv.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), F.col("_v")).alias("_r")).select("_r.*")

    def read(self) -> DataFrame | None:
        p = self._read_pointer()
        return None if p is None else self._resolve(p)

    def upsert(self, changes: DataFrame, batch_id: int) -> None:
        p = old = self._read_pointer() or {"batch_id": None, "base": None, "deltas": []}
        if p["batch_id"] is not None and batch_id <= p["batch_id"]:
            return  # already committed
        cols = [c for c in changes.columns]
        ordering = F.struct(*[F.col(o) for o in self.order])
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), ordering).alias("_r")) \
                      .select("_r.*").withColumn("_v", F.lit(int(batch_id)).cast("long"))
        last.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        p = {"batch_id": int(batch_id), "base": p.get("base"), "deltas": list(p.get("deltas", [])) + [int(batch_id)]}
        gone = list(old.get("stale", []))
        if len(p["deltas"]) >= self.compact_every:
            merged = self._resolve(p).withColumn("_v", F.lit(int(batch_id)).cast("long"))
            merged.write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            # superseded versions go one compaction later, when no reader holds them
            stale = ([f"base={p['base']}"] if p["base"] is not None else []) + [f"v={b}" for b in p["deltas"]]
            p = {"batch_id": int(batch_id), "base": int(batch_id), "deltas": [], "stale": stale}
        else:
            p["stale"], gone = gone, []
        self._write_pointer(p)
        fs, jvm = self._hfs()
        for d in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{d}"), True)


def upsert_latest(feed: DataFrame, path: str, keys=("actor1", "actor2"), order=("ts",),
                  checkpoint: str | None = None, trigger: dict | None = None):
    """Stream form of E3: ``foreachBatch`` into a ``LatestStateTable``."""
    table = LatestStateTable(feed.sparkSession, path, keys, order)
    w = feed.writeStream.foreachBatch(lambda df, bid: table.upsert(df, bid))
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(), table


# ---------------------------------------------------------- models

def model_text(df: DataFrame, id_col: str = "id", col: str = "factors") -> DataFrame:
    """``id:v1,v2,...`` with Java's double formatting (Spark's cast)."""
    return df.select(F.concat(F.col(id_col).cast("string"), F.lit(":"),
                              F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), ","))
                     .alias("value"))


def write_model(updates: DataFrame, path: str, id_col: str = "id", step_col: str = "step",
                col: str = "factors") -> None:
    """Last vector per id as text (E4): ``max_by(factors, step)`` per id."""
    last = updates.groupBy(id_col).agg(F.max_by(col, step_col).alias(col))
    model_text(last, id_col, col).write.mode("overwrite").text(path)


def write_model_stream(updates: DataFrame, path: str, checkpoint: str, id_col: str = "id",
                       col: str = "factors", trigger: dict | None = None):
    """Every model update as text (E5), appended per micro-batch."""
    w = model_text(updates, id_col, col).writeStream.format("text").outputMode("append") \
        .option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path)


def write_evaluations(evals: DataFrame, path: str | None = None, fmt: str = "csv", checkpoint: str | None = None):
    """Evaluation rows (E6): files for batch, any stream sink (``console`` as
    in the reference) for streams. No single-partition write."""
    if evals.isStreaming:
        w = evals.writeStream.format(fmt).outputMode("append")
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.start(path) if path else w.start()
    evals.write.mode("overwrite").format(fmt).option("header", "true").save(path)
    return None
