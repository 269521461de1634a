"""Country-level views over pair state and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.fixtures import EVENT_ORDER
from relflow.plans.ordered_scan import INF, Channel, ordered_scan

PAIR = ("actor1", "actor2")


def known_countries(df: DataFrame, dim: DataFrame, a: str = "actor1", b: str = "actor2",
                    country_col: str = "country") -> DataFrame:
    """Keep pairs whose two countries both exist in the dimension (D1): two
    ``left_semi`` joins. The planner broadcasts the dimension only when its
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``."""
    d = dim.select(F.col(country_col).alias("_c")).distinct()
    x = df.join(d, F.col(a) == F.col("_c"), "left_semi")
    return x.join(d, F.col(b) == F.col("_c"), "left_semi")


def mirror(df: DataFrame, a: str = "actor1", b: str = "actor2", value: str = "score",
           extra=()) -> DataFrame:
    """Symmetric relations (D2): every pair also as its reverse, in one pass
    (``explode`` of a one- or two-element array; a self pair is emitted once).
    Output columns ``actor1, actor2, value, extra...``."""
    ex = list(extra)
    fwd = F.struct(F.col(a).alias("actor1"), F.col(b).alias("actor2"), F.col(value).alias(value),
                   *[F.col(c) for c in ex])
    rev = F.struct(F.col(b).alias("actor1"), F.col(a).alias("actor2"), F.col(value).alias(value),
                   *[F.col(c) for c in ex])
    arr = F.when(F.col(a) == F.col(b), F.array(fwd)).otherwise(F.array(fwd, rev))
    return df.select(F.explode(arr).alias("_m")).select("_m.*")


def changes_only(feed: DataFrame, value: str = "score", keys=PAIR, order=EVENT_ORDER,
                 keep=()) -> DataFrame:
    """Drop updates whose value equals the previous value of the same pair
    (D3). The previous value is an exclusive last-value scan (skew-safe);
    rows are kept when ``NOT (value <=> prev)``."""
    ch = Channel("_prev", a=F.lit(0.0), b=F.col(value).cast("double"), init=0.0)
    res = ordered_scan(feed, list(keys), list(order), [ch], keep=list(dict.fromkeys(list(keep) + [value])),
                       exclusive=True)
    return res.filter(~F.col(value).cast("double").eqNullSafe(F.col("_prev_prev"))).drop("_prev", "_prev_prev")


def country_mean(df: DataFrame, value: str = "score", zero_as_one: bool = True,
                 mirrored: bool = False) -> DataFrame:
    """Mean relation per country over its current partners (D4). As in the
    reference, a mean of 0 or NaN becomes 1 (``zero_as_one``)."""
    m = df if mirrored else mirror(df, value=value)
    mean = F.avg(F.col(value))
    out = m.groupBy(F.col("actor1").alias("country")).agg(mean.alias("mean"))
    if zero_as_one:
        out = out.withColumn("mean", F.when((F.col("mean") == 0) | F.isnan("mean"), F.lit(1.0))
                             .otherwise(F.col("mean")))
    return out


def relations_of(df: DataFrame, country: str, value: str = "score", mirrored: bool = False) -> DataFrame:
    """All relations of one country (D5): ``partner, value``."""
    m = df if mirrored else mirror(df, value=value)
    return m.filter(F.col("actor1") == F.lit(country)).select(F.col("actor2").alias("partner"), F.col(value))


def relation_extent(df: DataFrame, value: str = "score", mirrored: bool = False) -> DataFrame:
    """Min and max relation per country."""
    m = df if mirrored else mirror(df, value=value)
    return m.groupBy(F.col("actor1").alias("country")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def relation_extent_feed(feed: DataFrame, value: str = "score", order=EVENT_ORDER,
                         keys=("country",)) -> DataFrame:
    """Running extent per country over a change feed (D6, feed form): a new
    value outside ``[lo, hi]`` widens it. Skew-safe running min/max scan."""
    x = F.col(value).cast("double")
    lo = Channel("lo", a=F.lit(1.0), b=F.lit(0.0), lo=F.lit(-INF), hi=x, init=INF)
    hi = Channel("hi", a=F.lit(1.0), b=F.lit(0.0), lo=x, hi=F.lit(INF), init=-INF)
    return ordered_scan(feed, list(keys), list(order), [lo, hi], keep=[value])


def activity_series(updates: DataFrame, width_ms: int, keep: int = 30, ts_col: str = "ts",
                    t0_ms: int | None = None) -> DataFrame:
    """Updates per fixed-width bucket (D7): bucket ``ceil((t - t0)/width) - 1``
    floored at 0 (right-closed buckets), empty buckets filled with 0, only
    closed buckets (all but the last), the last ``keep`` of them.
    ``t0`` defaults to the earliest update. Output ``bucket, t_start (ms), n``."""
    spark = updates.sparkSession
    t = F.col(ts_col) if dict(updates.dtypes)[ts_col] == "bigint" \
        else F.unix_millis(F.col(ts_col).cast("timestamp"))
    d = updates.select(t.alias("_t")).filter(F.col("_t").isNotNull())
    least, most = d.agg(F.min("_t"), F.max("_t")).first()
    if least is None:
        return spark.createDataFrame([], "bucket bigint, t_start bigint, n bigint")
    t0_ms = least if t0_ms is None else t0_ms
    w = int(width_ms)
    last = max(-(-(most - t0_ms) // w) - 1, 0)
    first = max(last - keep, 0)
    if first:       # earlier buckets are not shown: their rows need not be read
        d = d.filter(F.col("_t") > F.lit(t0_ms + first * w))
    bucket = F.greatest(F.expr(f"(_t - ({t0_ms}) + {w - 1}) div {w}") - 1, F.lit(0)).cast("long")
    counts = d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(max(last - keep, 0), last).withColumnRenamed("id", "bucket")
    return grid.join(counts, "bucket", "left").select(
        "bucket", (F.lit(t0_ms) + F.col("bucket") * F.lit(w)).alias("t_start"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def activity_summary(series: DataFrame, width_ms: int) -> DataFrame:
    """Max, rounded mean (JavaScript ``Math.round`` = ``floor(x + 0.5)``) and
    the rate label ``mean / width`` per second (D8)."""
    return series.agg(F.max("n").alias("max_n"), F.floor(F.avg("n") + F.lit(0.5)).cast("long").alias("mean_n")) \
                 .withColumn("rate_per_sec", F.col("mean_n") * F.lit(1000.0) / F.lit(float(width_ms)))


def score_classes(df: DataFrame, value: str = "score", n: int = 9) -> DataFrame:
    """Equal-width classes ``0..n-1`` of a value between its min and max (D9);
    null / NaN values are skipped; ``hi == lo`` gives class 0."""
    v = F.col(value)
    d = df.filter(v.isNotNull() & ~F.isnan(v))
    lo, hi = d.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return d.withColumn("class", F.lit(None).cast("int"))
    if hi == lo:
        return d.withColumn("class", F.lit(0))
    cls = F.least(F.greatest(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(n)), F.lit(0)), F.lit(n - 1))
    return d.withColumn("class", cls.cast("int"))


def nested_state(df: DataFrame, value: str = "score") -> DataFrame:
    """State as ``{actor1: {actor2: value}}`` (D10): one row per actor1 with a
    ``map<string,double>`` of its partners, built with a partial aggregation."""
    return df.groupBy("actor1").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("actor2"), F.col(value))))).alias("relations"))
