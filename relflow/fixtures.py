"""Views that present the driver tables in the shapes the operators consume.

The event file, ratings and factor tables of the reference are not available;
these views derive rows of the same schema from the TPC-H-like driver tables.
They only build input rows; every operator does its own work on them. Each
view has a Spark builder and the same view as DuckDB SQL (for oracles).

Event-file column names are kept (``actor1Code_countryCode``, ``quadClass``,
``day``, ``dateAdded``); ``k1..k4`` stand for the event id and order ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Order of events inside the event stream (ties of the same day).
EVENT_ORDER = ("k1", "k2", "k3", "k4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str, quad_mod: int = 4) -> DataFrame:
    """Event rows: ``k1..k4, actor1Code_countryCode, actor2Code_countryCode,
    quadClass, day (date), dateAdded (date)``.

    ``quad_mod=4`` gives classes 1-4; ``quad_mod=6`` gives ``l_linenumber % 6``
    with unknown classes 0 and 5.
    """
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              "l_quantity", "l_shipdate")
    o = t("orders").select("o_orderkey", "o_custkey")
    c = t("customer").select("c_custkey", "c_nationkey")
    s = t("supplier").select("s_suppkey", "s_nationkey")
    # nation is a fixed 25-row dimension: broadcast is bounded by construction
    nc = F.broadcast(t("nation").select(F.col("n_nationkey").alias("nc_key"), F.col("n_name").alias("nc_name")))
    ns = F.broadcast(t("nation").select(F.col("n_nationkey").alias("ns_key"), F.col("n_name").alias("ns_name")))
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(s, li.l_suppkey == s.s_suppkey)
           .join(nc, c.c_nationkey == nc.nc_key)
           .join(ns, s.s_nationkey == ns.ns_key))
    quad = (F.col("l_linenumber") % 4 + 1) if quad_mod == 4 else (F.col("l_linenumber") % 6)
    return j.select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise(F.col("nc_name"))
         .alias("actor1Code_countryCode"),
        F.col("ns_name").alias("actor2Code_countryCode"),
        quad.cast("int").alias("quadClass"),
        F.when(F.col("l_quantity") == 1, F.lit(None).cast("date"))
         .otherwise(F.col("l_shipdate").cast("date")).alias("day"),
        F.col("l_shipdate").cast("date").alias("dateAdded"),
    )


def interactions_sql(quad_mod: int = 4) -> str:
    quad = "(l_linenumber % 4) + 1" if quad_mod == 4 else "l_linenumber % 6"
    return f"""
SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE nc.n_name END AS actor1Code_countryCode,
       ns.n_name AS actor2Code_countryCode,
       CAST({quad} AS INTEGER) AS quadClass,
       CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day,
       CAST(l_shipdate AS DATE) AS dateAdded
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN customer ON o_custkey  = c_custkey
JOIN supplier ON l_suppkey  = s_suppkey
JOIN nation nc ON c_nationkey = nc.n_nationkey
JOIN nation ns ON s_nationkey = ns.n_nationkey"""


def snapshot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot request times: the distinct months of the ship dates."""
    return (table(spark, sf_dir, "lineitem")
            .select(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("request_ts"))
            .distinct())


SNAPSHOT_REQUESTS_SQL = "SELECT DISTINCT date_trunc('month', l_shipdate) AS request_ts FROM lineitem"


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 4).select(F.col("n_name").alias("country"))


COUNTRIES_SQL = "SELECT n_name AS country FROM nation WHERE n_regionkey <> 4"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").hint("shuffle_hash")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        F.lit(1.0).alias("rating"), F.col("o_orderdate").alias("ts"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"))


RATINGS_SQL = """
SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1.0 AS DOUBLE) AS rating,
       o_orderdate AS ts, l_orderkey AS k1, l_linenumber AS k2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing user model: every embedding as the vector of the user with its id."""
    e = table(spark, sf_dir, "embeddings")
    scale = (F.when(F.col("vec_id") % 3 == 0, F.lit(0.1)).when(F.col("vec_id") % 3 == 1, F.lit(1.0))
             .otherwise(F.lit(3.0)))
    return e.select(F.col("vec_id").alias("user_id"),
                    F.transform("embedding", lambda x: x.cast("double") * scale).alias("factors"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The existing item model: every embedding as the vector of the item with its id."""
    e = table(spark, sf_dir, "embeddings")
    scale = F.lit(0.5) + F.lit(0.1) * (F.col("vec_id") % 10)
    return e.select(F.col("vec_id").alias("item_id"),
                    F.transform("embedding", lambda x: x.cast("double") * scale).alias("factors"))


USER_VECTORS_SQL = """
SELECT vec_id AS user_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE) *
         CASE vec_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 ELSE 3.0 END) AS factors
FROM embeddings"""

ITEM_VECTORS_SQL = """
SELECT vec_id AS item_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (0.5 + 0.1 * (vec_id % 10))) AS factors
FROM embeddings"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an update stream: ``ts`` event time,
    ``(user_id, event_type)`` key."""
    return table(spark, sf_dir, "events")
