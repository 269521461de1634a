"""Rating / evaluation-request text files and snapshot-request streams (A3, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.sinks.writers import LatestStateTable
from relflow.sources.ids import assign_evaluation_id, assign_ordered_ids

_RAW = T.StructType([T.StructField("_c0", T.StringType()), T.StructField("_c1", T.StringType()),
                     T.StructField("_c2", T.StringType())])


def _shape(df: DataFrame, layout: str) -> DataFrame:
    if layout == "rating":
        # field 0 is ignored; rating fixed to 1.0
        return df.select(F.col("_c1").try_cast("int").alias("user_id"), F.col("_c2").try_cast("int").alias("item_id"),
                         F.lit(1.0).alias("rating"))
    if layout == "evaluation":
        # field 0 = epoch seconds; id generated per request
        d = df.select(F.col("_c0").try_cast("long").alias("ts"), F.col("_c1").try_cast("int").alias("user_id"),
                      F.col("_c2").try_cast("int").alias("item_id"), F.lit(1.0).alias("rating"))
        return d if df.isStreaming else assign_evaluation_id(d)
    raise ValueError(f"layout: {layout}")


def read_ratings(spark: SparkSession, path: str, layout: str = "rating") -> DataFrame:
    """Comma-separated rating text without header (A3). ``layout="rating"``:
    ``user_id, item_id, rating=1.0`` from fields 1 and 2; ``"evaluation"``:
    ``ts, user_id, item_id, rating=1.0, evaluation_id`` from fields 0-2."""
    return _shape(spark.read.schema(_RAW).option("header", "false").csv(path), layout)


def stream_ratings(spark: SparkSession, path: str, layout: str = "rating",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream (A3). Requests get their ids micro-batch by
    micro-batch, see ``foreach_evaluations``."""
    r = spark.readStream.schema(_RAW).option("header", "false")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _shape(r.csv(path), layout)


def foreach_evaluations(requests: DataFrame, ids_path: str, run, checkpoint: str, trigger: dict | None = None):
    """Start a query that calls ``run(batch, batch_id)`` with ``evaluation_id`` on
    every request of a stream of layout "evaluation": ids go on from the last
    committed one, in the order ``(ts, user_id, item_id)``. A batch that is
    replayed gets the ids it had."""
    table = LatestStateTable(requests.sparkSession, ids_path, keys=("batch",), order=("next",))

    def numbered(batch: DataFrame, batch_id: int) -> None:
        ids = table.read()
        before = ids.filter(F.col("batch") < batch_id) if ids is not None else None
        start = (before.agg(F.max("next")).first()[0] if before is not None else None) or 0
        out = assign_ordered_ids(batch, ["ts", "user_id", "item_id"], out="evaluation_id")
        out = out.withColumn("evaluation_id", F.col("evaluation_id") + F.lit(int(start))).checkpoint()
        run(out, batch_id)
        table.upsert(batch.sparkSession.createDataFrame([(batch_id, start + out.count())], "batch long, next long"), batch_id)

    w = requests.writeStream.foreachBatch(numbered).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def stream_snapshot_requests(spark: SparkSession, fmt: str = "kafka", options: dict | None = None,
                             path: str | None = None, time_col: str | None = "timestamp") -> DataFrame:
    """Snapshot requests (A5): a stream of strings, only the value ``yes``
    counts. ``fmt="kafka"`` with ``subscribe``/bootstrap options in production
    (the connector jar must be on the classpath); any text-valued source
    works, e.g. ``fmt="text"`` on a folder in tests. Output ``request_ts``
    (the source's time column, or the arrival time when it has none)."""
    r = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    df = r.load(path) if path else r.load()
    ts = F.col(time_col) if time_col and time_col in df.columns else F.current_timestamp()
    return df.filter(F.col("value").cast("string") == F.lit("yes")).select(ts.alias("request_ts"))
