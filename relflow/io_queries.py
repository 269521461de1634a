"""Registered queries of the sources, the sinks and the streaming operators.

A source query writes the view of ``relflow.fixtures`` in the source's own file
format into a new folder under the shared checkpoint folder and reads it back
through the operator; a sink query writes through the operator and reads the
files; a stream query runs with an ``availableNow`` trigger, several times over
growing input. Each has the SQL of the rows that must come out.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow import fixtures as fx
from relflow import queries as Q
from relflow.operators import factors as FX
from relflow.operators import interactions as B
from relflow.operators import state as C
from relflow.queries import K, ORDER, _sql_r6, q, r6
from relflow.session import checkpoint_dir
from relflow.sinks import writers as W
from relflow.sinks.history import ChangeHistory
from relflow.sources import events as EV
from relflow.sources import ratings as RT
from relflow.streaming import relation_state as RS
from relflow.streaming import scan_state as SS
from relflow.streaming.sessions import stream_snapshots

NOW = {"availableNow": True}


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def slices(df: DataFrame, col: str, n: int = 3) -> list[DataFrame]:
    """``df`` in ``n`` parts by the value of a whole-number column, in its order."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    cuts = [lo + (hi - lo + 1) * i // n for i in range(n + 1)]
    return [df.where((F.col(col) >= a) & (F.col(col) < b)) for a, b in zip(cuts[:-1], cuts[1:])]


# ------------------------------------------------------------ event files

EVENT_SQL = f"""SELECT CAST(k1 * 8 + k2 AS INTEGER) AS event_id, actor1Code_countryCode AS a1, actor2Code_countryCode AS a2,
  quadClass AS quad, strftime(day, '%Y-%m-%d') AS day, strftime(dateAdded, '%Y-%m-%d') AS added FROM ({Q.INTERACTIONS}) i"""


def event_lines(spark, sf) -> DataFrame:
    d = fx.interactions(spark, sf)
    text = {"globalEventID": (F.col("k1") * 8 + F.col("k2")).cast("string"), B.A1: F.col(B.A1), B.A2: F.col(B.A2),
            "quadClass": F.col("quadClass").cast("string"), "day": F.date_format("day", "yyyyMMdd"),
            "dateAdded": F.date_format("dateAdded", "yyyyMMdd")}
    return d.select(F.concat_ws("\t", *[F.coalesce(text[n], F.lit("")) if n in text else F.lit("") for n, _ in EV.event_columns()]).alias("value"))


def event_rows(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("globalEventID").alias("event_id"), F.col(B.A1).alias("a1"), F.col(B.A2).alias("a2"),
                     F.col("quadClass").alias("quad"), F.date_format("day", "yyyy-MM-dd").alias("day"),
                     F.date_format("dateAdded", "yyyy-MM-dd").alias("added"))


@q("read_events", EVENT_SQL)
def _a1(spark, sf):
    d = folder(spark)
    event_lines(spark, sf).write.text(d)
    return event_rows(EV.read_events(spark, d))


@q("stream_events", EVENT_SQL)
def _a2(spark, sf):
    d = folder(spark)
    event_lines(spark, sf).write.text(f"{d}/in")
    event_rows(EV.stream_events(spark, f"{d}/in")).writeStream.format("parquet").option("checkpointLocation", f"{d}/ck") \
        .trigger(**NOW).start(f"{d}/out").awaitTermination()
    return spark.read.parquet(f"{d}/out")


# ----------------------------------------------------- ratings and requests

@q("read_ratings", f"""SELECT CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id, rating FROM ({fx.RATINGS_SQL}) r""")
def _a3(spark, sf):
    d = folder(spark)
    fx.ratings(spark, sf).select(F.concat_ws(",", F.lit("x"), "user_id", "item_id").alias("value")).write.text(d)
    return RT.read_ratings(spark, d)


@q("stream_evaluations", f"""SELECT ts, user_id, item_id, row_number() OVER (ORDER BY ts, user_id, item_id) - 1 AS evaluation_id
FROM (SELECT CAST(epoch(ts) AS BIGINT) AS ts, CAST(user_id AS INTEGER) AS user_id, CAST(item_id AS INTEGER) AS item_id FROM ({fx.RATINGS_SQL}) r) x""")
def _a3s(spark, sf):
    """Evaluation requests in three runs of one stream: ids go on over the runs."""
    d = folder(spark)
    r = fx.ratings(spark, sf).select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "item_id")
    for part in slices(r, "ts"):
        part.select(F.concat_ws(",", "ts", "user_id", "item_id").alias("value")).write.mode("append").text(f"{d}/in")
        RT.foreach_evaluations(RT.stream_ratings(spark, f"{d}/in", "evaluation"), f"{d}/ids",
                               lambda b, i: b.write.mode("overwrite").parquet(f"{d}/out/batch={i}"), f"{d}/ck", NOW).awaitTermination()
    return spark.read.parquet(f"{d}/out").select("ts", "user_id", "item_id", "evaluation_id")


@q("stream_snapshot_requests", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def _a5(spark, sf):
    d = folder(spark)
    fx.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "yes").otherwise(F.col("l_returnflag")).alias("value")).write.text(f"{d}/in")
    RT.stream_snapshot_requests(spark, fmt="text", path=f"{d}/in").writeStream.format("parquet").option("checkpointLocation", f"{d}/ck") \
        .trigger(**NOW).start(f"{d}/out").awaitTermination()
    return spark.read.parquet(f"{d}/out").agg(F.count("request_ts").alias("n"))


# -------------------------------------------------------- keyed stream state

def _in_runs(spark, rows: DataFrame, by: str, stateful) -> DataFrame:
    """All rows that a stateful stream emits over three runs."""
    d = folder(spark)
    for part in slices(rows, by):
        part.write.mode("append").parquet(f"{d}/in")
        out = stateful(spark.readStream.schema(rows.schema).parquet(f"{d}/in"))
        (out.writeStream.outputMode("update").option("checkpointLocation", f"{d}/ck").trigger(**NOW)
         .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{d}/out/batch={i}")).start().awaitTermination())
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{d}/out")


@q("stream_relation_scores", Q.RELATION_FEED_SQL + f"""
SELECT actor1, actor2, k1, k2, k3, k4, ts, {_sql_r6("s")} AS raw_score, {_sql_r6("s / nn")} AS score FROM st""")
def _c11(spark, sf):
    rows = Q.signed(spark, sf).select("actor1", "actor2", "ts", *ORDER, "score").checkpoint()
    out = _in_runs(spark, rows, "ts", lambda s: RS.stream_relation_scores(s, lam=Q.LAM, order=ORDER))
    return out.select("actor1", "actor2", *ORDER, "ts", r6("raw_score").alias("raw_score"), r6("score").alias("score"))


@q("stream_counts", Q.ORACLES["interaction_counts_feed"])
def _c11c(spark, sf):
    rows = Q.pairs(spark, sf).select("actor1", "actor2", *ORDER).checkpoint()
    return _in_runs(spark, rows, "k1", lambda s: RS.stream_counts(s, order=ORDER)).select("actor1", "actor2", *ORDER, "n")


def _scanned(spark, rows: DataFrame, by: str, start) -> DataFrame:
    """All rows that a scanning stream hands to its sink over three runs."""
    d = folder(spark)
    sink = lambda changes, i: changes.write.mode("overwrite").parquet(f"{d}/out/batch={i}")
    for part in slices(rows, by):
        part.write.mode("append").parquet(f"{d}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), f"{d}/state", f"{d}/ck", sink)[0].awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{d}/out")


@q("stream_relation_scores_scan", Q.ORACLES["stream_relation_scores"])
def _c11s(spark, sf):
    rows = Q.signed(spark, sf).select("actor1", "actor2", "ts", *ORDER, "score").checkpoint()
    out = _scanned(spark, rows, "ts", lambda s, *a: SS.start_relation_scores(s, *a, lam=Q.LAM, order=ORDER, trigger=NOW))
    return out.select("actor1", "actor2", *ORDER, "ts", r6("raw_score").alias("raw_score"), r6("score").alias("score"))


@q("stream_counts_scan", Q.ORACLES["stream_counts"])
def _c11cs(spark, sf):
    rows = Q.pairs(spark, sf).select("actor1", "actor2", *ORDER).checkpoint()
    return _scanned(spark, rows, "k1", lambda s, *a: SS.start_counts(s, *a, order=ORDER, trigger=NOW)).select("actor1", "actor2", *ORDER, "n")


@q("stream_counts_windowed", f"""WITH e AS (SELECT *, COALESCE(epoch_ms(CAST(dateAdded AS TIMESTAMP)), -1) AS ts FROM ({Q.PAIRS_SQL}) p)
SELECT * FROM (SELECT actor1, actor2, w * {Q.WEEK_MS} AS window_start, (w + 1) * {Q.WEEK_MS} AS window_end, CAST(sum(quadClass) AS BIGINT) AS n
  FROM (SELECT *, ts // {Q.WEEK_MS} AS w FROM e WHERE ts >= 0) x GROUP BY actor1, actor2, w) y
WHERE window_end <= (SELECT max(ts) FROM e)""")
def _c3(spark, sf):
    """Weighted windows over three runs: the windows that the last event closes."""
    rows = B.event_time_or(Q.pairs(spark, sf)).select("actor1", "actor2", "ts", "quadClass").checkpoint()
    d = folder(spark)
    for part in slices(rows, "ts"):
        part.write.mode("append").parquet(f"{d}/in")
        out = RS.stream_counts_windowed(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), width="7 days", weight="quadClass")
        out.writeStream.format("parquet").option("checkpointLocation", f"{d}/ck").trigger(**NOW).start(f"{d}/out").awaitTermination()
    return spark.read.parquet(f"{d}/out")


@q("stream_changes_only", Q.ORACLES["changes_only"])
def _d3(spark, sf):
    rows = C.relation_scores_feed(Q.signed(spark, sf), lam=Q.LAM, order=ORDER).select("actor1", "actor2", "ts", *ORDER, r6("score").alias("score")).checkpoint()
    return _in_runs(spark, rows, "ts", RS.stream_changes_only).select("actor1", "actor2", *ORDER, "score")


@q("snapshot_relation_raw", Q.RELATION_FEED_SQL + f""",
req AS (SELECT DISTINCT epoch_ms(request_ts) AS r FROM ({fx.SNAPSHOT_REQUESTS_SQL}) q),
seen AS (SELECT r, actor1, actor2, s, row_number() OVER (PARTITION BY r, actor1, actor2 ORDER BY rn DESC) AS back
         FROM req JOIN st ON st.ts <= req.r)
SELECT r AS request_ts, actor1, actor2, {_sql_r6("s")} AS raw_score FROM seen WHERE back = 1""")
def _c10(spark, sf):
    feed = C.relation_scores_feed(Q.signed(spark, sf), lam=Q.LAM, order=ORDER)
    res = C.snapshot_at(fx.snapshot_requests(spark, sf), feed, "raw_score", order=ORDER)
    return res.select("request_ts", "actor1", "actor2", r6("raw_score").alias("raw_score"))


@q("stream_snapshot_relation_raw", Q.ORACLES["snapshot_relation_raw"])
def _c10s(spark, sf):
    """The changes come over three runs of the score stream into a history, then the
    requests as a stream of their own: each gets the state as of its time."""
    rows = Q.signed(spark, sf).select("actor1", "actor2", "ts", *ORDER, "score").checkpoint()
    d = folder(spark)
    history = ChangeHistory(spark, f"{d}/history", order=ORDER, base_every=2)
    for part in slices(rows, "ts"):
        part.write.mode("append").parquet(f"{d}/in")
        scores = RS.stream_relation_scores(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), lam=Q.LAM, order=ORDER)
        (scores.writeStream.outputMode("update").option("checkpointLocation", f"{d}/ck").trigger(**NOW)
         .foreachBatch(lambda b, i: history.append(b.checkpoint(), i)).start().awaitTermination())
    fx.snapshot_requests(spark, sf).write.parquet(f"{d}/requests")
    asked = spark.readStream.schema("request_ts timestamp").parquet(f"{d}/requests")
    stream_snapshots(asked, history, f"{d}/out", f"{d}/ck_requests", trigger=NOW).awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{d}/out").where("actor1 IS NOT NULL")
    return out.select("request_ts", "actor1", "actor2", r6("raw_score").alias("raw_score"))


# ------------------------------------------------------------------- sinks

@q("write_changes", f"""SELECT '{{"actor1":"' || actor1 || '","actor2":"' || actor2 || '","score":' || n || '}}' AS value
FROM ({Q.ORACLES["interaction_counts_feed"]}) f""")
def _e1(spark, sf):
    d = folder(spark)
    W.write_changes(Q.QUERIES["interaction_counts_feed"](spark, sf), d, value="n")
    return spark.read.text(d)


@q("write_snapshots", f"""SELECT '[' || string_agg('{{"_1":"' || actor1 || '","_2":"' || actor2 || '","_3":' || n || '}}', ',' ORDER BY actor1, actor2) || ']' AS value
FROM ({Q.ORACLES["snapshot_counts"]}) s GROUP BY request_ts""")
def _e2(spark, sf):
    d = folder(spark)
    W.write_snapshots(Q.QUERIES["snapshot_counts"](spark, sf), d, value="n")
    return spark.read.text(d)


MESSAGE_BYTES = 512


@q("write_snapshots_bounded", f"""WITH i AS (SELECT request_ts, actor1, actor2, '{{"_1":"' || actor1 || '","_2":"' || actor2 || '","_3":' || n || '}}' AS j
    FROM ({Q.ORACLES["snapshot_counts"]}) s),
  c AS (SELECT *, sum(strlen(j) + 1) OVER (PARTITION BY request_ts ORDER BY actor1, actor2) - strlen(j) - 1 AS before FROM i)
SELECT request_ts, CAST(before // {MESSAGE_BYTES} AS BIGINT) AS part, '[' || string_agg(j, ',' ORDER BY actor1, actor2) || ']' AS value FROM c GROUP BY 1, 2""")
def _e2b(spark, sf):
    return W.bounded_snapshot_messages(Q.QUERIES["snapshot_counts"](spark, sf), "n", max_bytes=MESSAGE_BYTES)


@q("upsert_latest", Q.ORACLES["interaction_counts"])
def _e3(spark, sf):
    d = folder(spark)
    rows = Q.QUERIES["interaction_counts_feed"](spark, sf).checkpoint()
    for part in slices(rows, "k1"):
        part.write.mode("append").parquet(f"{d}/in")
        query, table = W.upsert_latest(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), f"{d}/state", order=("n",),
                                       checkpoint=f"{d}/ck", trigger=NOW)
        query.awaitTermination()
    return table.read().select("actor1", "actor2", "n")


def _model_rows(text: DataFrame) -> DataFrame:
    parts = F.split("value", "[:,]")
    return text.select(parts[0].cast("long").alias("item_id"), F.posexplode(F.slice(parts, 2, K)).alias("pos", "v")) \
               .select("item_id", "pos", r6(F.col("v").cast("double")).alias("v"))


def _model_updates(spark, sf) -> DataFrame:
    """Two steps of a model over the rated items."""
    ids = Q.ratings(spark, sf).select("item_id").distinct()
    one = FX.init_factors(ids, "item_id", FX.seeded_init(K)).withColumn("step", F.lit(1))
    two = FX.init_factors(ids, "item_id", FX.ranged_init(K, -1.0, 1.0)).withColumn("step", F.lit(2))
    return one.unionByName(two).withColumnRenamed("item_id", "id")


@q("write_model", Q.ORACLES["init_factors_ranged"])
def _e4(spark, sf):
    d = folder(spark)
    W.write_model(_model_updates(spark, sf), d)
    return _model_rows(spark.read.text(d))


@q("write_model_stream", "WITH RECURSIVE " + Q._rng_sql("iv", Q.RATED_ITEMS, K, -1.0, 1.0) + ", " + Q._rng_sql("sv", Q.RATED_ITEMS, K) + f"""
SELECT id AS item_id, pos, {_sql_r6("v")} AS v FROM iv UNION ALL SELECT id, pos, {_sql_r6("v")} FROM sv""")
def _e5(spark, sf):
    d = folder(spark)
    rows = _model_updates(spark, sf)
    rows.write.parquet(f"{d}/in")
    W.write_model_stream(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), f"{d}/out", f"{d}/ck", trigger=NOW).awaitTermination()
    return _model_rows(spark.read.text(f"{d}/out"))


@q("write_evaluations", Q.ORACLES["ndcg"])
def _e6(spark, sf):
    d = folder(spark)
    W.write_evaluations(Q.QUERIES["ndcg"](spark, sf), d)
    return spark.read.option("header", "true").schema("request_id long, ndcg double").csv(d)


@q("init_factors_python", f"""SELECT id AS item_id, CAST(p AS INTEGER) AS pos, {_sql_r6("id * 0.5 + p / 8.0")} AS v
FROM ({Q.RATED_ITEMS}) i, generate_series(0, {K - 1}) g(p)""")
def _f4(spark, sf):
    ids = Q.ratings(spark, sf).select("item_id").distinct()
    return Q._long(FX.init_factors(ids, "item_id", FX.python_init(lambda i: i * 0.5 + np.arange(K) / 8.0)), "item_id")
