"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that computes the same rows from the same driver tables.

Every query reads the whole driver tables (through the views of
``relflow.fixtures``). Doubles are rounded to 6 digits (plus 0.0, which turns
-0.0 into 0.0) on both sides; times are epoch milliseconds.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow import fixtures as fx
from relflow.operators import interactions as B
from relflow.operators import state as C
from relflow.operators.folds import Monoid, Sequential

ORDER = ("k1", "k2", "k3", "k4")
LAM = C.DEFAULT_LAMBDA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ SQL parts

def _sql_r6(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


INTERACTIONS = fx.interactions_sql(4)
B1_SQL = f"""SELECT * FROM ({INTERACTIONS}) i
WHERE actor1Code_countryCode IS NOT NULL AND actor2Code_countryCode IS NOT NULL"""
DAY_MS = "(epoch_ms(CAST(day AS TIMESTAMP)))"
B5_SQL = f"""SELECT *, COALESCE(last_value({DAY_MS} IGNORE NULLS) OVER (
    ORDER BY k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1490738400000) AS ts
FROM ({B1_SQL}) b1"""
QUAD_CASE = ("CASE quadClass WHEN 1 THEN CAST(0.01 AS DOUBLE) WHEN 2 THEN CAST(0.02 AS DOUBLE) "
             "WHEN 3 THEN CAST(-0.01 AS DOUBLE) WHEN 4 THEN CAST(-0.02 AS DOUBLE) END")
SIGNED_SQL = f"""SELECT k1, k2, k3, k4,
  greatest(actor1Code_countryCode, actor2Code_countryCode) AS actor1,
  least(actor1Code_countryCode, actor2Code_countryCode) AS actor2,
  quadClass, ts, {QUAD_CASE} AS score
FROM ({B5_SQL}) b5 WHERE quadClass IN (1, 2, 3, 4)"""
PAIRS_SQL = f"""SELECT k1, k2, k3, k4,
  greatest(actor1Code_countryCode, actor2Code_countryCode) AS actor1,
  least(actor1Code_countryCode, actor2Code_countryCode) AS actor2,
  quadClass, day, dateAdded
FROM ({B1_SQL}) b1"""


def _fold_sql(src: str, state_step: str, norm_step: str | None, first_state: str, first_norm: str | None) -> str:
    """Recursive-CTE oracle of an ordered per-pair fold (one step per event)."""
    norm_cols = ", nn" if norm_step else ""
    first_n = f", {first_norm} AS nn" if norm_step else ""
    step_n = f", {norm_step}" if norm_step else ""
    return f"""WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY actor1, actor2 ORDER BY ts, k1, k2, k3, k4) AS rn FROM ({src}) s
), st AS (
  SELECT actor1, actor2, rn, ts, k1, k2, k3, k4, {first_state} AS s{first_n} FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.actor1, e.actor2, e.rn, e.ts, e.k1, e.k2, e.k3, e.k4, {state_step}{step_n}
  FROM st JOIN ev e ON e.actor1 = st.actor1 AND e.actor2 = st.actor2 AND e.rn = st.rn + 1
)"""


def _decay_step(prev: str, x: str, lam: float = LAM, bound: float = 100.0) -> str:
    d = f"st.{prev} * exp(-{lam!r} * (e.ts - st.ts))"
    return (f"(CASE WHEN isnan({d}) THEN 0.0 ELSE greatest(least({d}, {bound!r}), -{bound!r}) END + {x})")


RELATION_FEED_SQL = _fold_sql(SIGNED_SQL, _decay_step("s", "e.score"), _decay_step("nn", "1.0"),
                              "score", "CAST(1.0 AS DOUBLE)")


# ------------------------------------------------------------- B operators

def _events(spark, sf):
    return fx.interactions(spark, sf)


@q("with_both_actors", f"""SELECT k1, k2, k3, k4, actor1Code_countryCode, actor2Code_countryCode FROM ({B1_SQL}) x""")
def _b1(spark, sf):
    return B.with_both_actors(_events(spark, sf)).select(*ORDER, B.A1, B.A2)


@q("canonical_pair", f"SELECT k1, k2, k3, k4, actor1, actor2 FROM ({PAIRS_SQL}) x")
def _b2(spark, sf):
    return B.canonical_pair(B.with_both_actors(_events(spark, sf))).select(*ORDER, "actor1", "actor2")


QUAD6 = fx.interactions_sql(6)


@q("quad_score", f"""SELECT k1, k2, k3, k4, quadClass, {_sql_r6(QUAD_CASE)} AS score
FROM ({QUAD6}) i WHERE quadClass IN (1, 2, 3, 4)""")
def _b3(spark, sf):
    d = B.quad_score(fx.interactions(spark, sf, quad_mod=6))
    return d.select(*ORDER, "quadClass", r6("score").alias("score"))


@q("quad_score_unknown", f"""SELECT k1, k2, k3, k4, quadClass FROM ({QUAD6}) i
WHERE quadClass IS NULL OR quadClass NOT IN (1, 2, 3, 4)""")
def _b3u(spark, sf):
    return B.unknown_quad_rows(fx.interactions(spark, sf, quad_mod=6)).select(*ORDER, "quadClass")


@q("quad_score_normalized", f"""SELECT k1, k2, k3, k4, {_sql_r6(f"({QUAD_CASE}) / 4.0")} AS score
FROM ({INTERACTIONS}) i WHERE quadClass IN (1, 2, 3, 4)""")
def _b4(spark, sf):
    d = B.quad_score(_events(spark, sf), norm=4.0)
    return d.select(*ORDER, r6("score").alias("score"))


@q("event_time_locf", f"SELECT k1, k2, k3, k4, ts FROM ({B5_SQL}) x")
def _b5(spark, sf):
    d = B.with_both_actors(_events(spark, sf)).withColumn("source", F.lit("events"))
    return B.event_time_locf(d, partition_cols=("source",), order_cols=ORDER).select(*ORDER, "ts")


@q("event_time_or", f"""SELECT k1, k2, k3, k4, COALESCE(epoch_ms(CAST(dateAdded AS TIMESTAMP)), -1) AS ts
FROM ({INTERACTIONS}) i""")
def _b6(spark, sf):
    return B.event_time_or(_events(spark, sf)).select(*ORDER, "ts")


# ------------------------------------------------------------- C operators

def signed(spark, sf) -> DataFrame:
    return B.signed_interactions(_events(spark, sf), order_cols=ORDER)


def pairs(spark, sf) -> DataFrame:
    return B.canonical_pair(B.with_both_actors(_events(spark, sf)))


@q("interaction_counts_feed", f"""SELECT actor1, actor2, k1, k2, k3, k4,
  count(*) OVER (PARTITION BY actor1, actor2 ORDER BY k1, k2, k3, k4
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
FROM ({PAIRS_SQL}) p""")
def _c1(spark, sf):
    return C.interaction_counts_feed(pairs(spark, sf), order=ORDER).select("actor1", "actor2", *ORDER, "n")


@q("interaction_counts", f"SELECT actor1, actor2, count(*) AS n FROM ({PAIRS_SQL}) p GROUP BY actor1, actor2")
def _c2(spark, sf):
    return C.interaction_counts(pairs(spark, sf))


WEEK_MS = 7 * 86400000


@q("interaction_counts_windowed", f"""SELECT actor1, actor2,
  (ts // {WEEK_MS}) * {WEEK_MS} AS window_start, (ts // {WEEK_MS}) * {WEEK_MS} + {WEEK_MS} AS window_end,
  count(*) AS n
FROM (SELECT *, COALESCE(epoch_ms(CAST(dateAdded AS TIMESTAMP)), -1) AS ts FROM ({PAIRS_SQL}) p) x
WHERE ts >= 0 GROUP BY ALL""")
def _c3(spark, sf):
    d = B.event_time_or(pairs(spark, sf))
    return C.interaction_counts_windowed(d, width="7 days")


@q("relation_scores_feed", RELATION_FEED_SQL + f"""
SELECT actor1, actor2, k1, k2, k3, k4, ts, {_sql_r6("s / nn")} AS score FROM st""")
def _c4(spark, sf):
    res = C.relation_scores_feed(signed(spark, sf), lam=LAM, order=ORDER)
    return res.select("actor1", "actor2", *ORDER, "ts", r6("score").alias("score"))


_STATE_TAIL = f"""
SELECT actor1, actor2, {_sql_r6("s")} AS raw_score, {_sql_r6("nn")} AS norm, {_sql_r6("s / nn")} AS score,
       ts AS last_ts, rn AS n
FROM (SELECT *, row_number() OVER (PARTITION BY actor1, actor2 ORDER BY rn DESC) AS back FROM st) z
WHERE back = 1"""


@q("relation_scores", RELATION_FEED_SQL + _STATE_TAIL)
def _c5(spark, sf):
    res = C.relation_scores(signed(spark, sf), lam=LAM, order=ORDER)
    return res.select("actor1", "actor2", r6("raw_score").alias("raw_score"), r6("norm").alias("norm"),
                      r6("score").alias("score"), "last_ts", "n")


@q("relation_scores_by_day", RELATION_FEED_SQL + _STATE_TAIL)
def _c6(spark, sf):
    res = C.relation_scores_by_day(signed(spark, sf), lam=LAM, order=ORDER)
    return res.select("actor1", "actor2", r6("raw_score").alias("raw_score"), r6("norm").alias("norm"),
                      r6("score").alias("score"), "last_ts", "n")


WEIGHT = 0.7
SUM_FEED_SQL = f"""SELECT actor1, actor2, k1, k2, k3, k4,
  {_sql_r6("sum(score) OVER (PARTITION BY actor1, actor2 ORDER BY ts, k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS value
FROM ({SIGNED_SQL}) s"""
WEIGHTED_SQL = _fold_sql(SIGNED_SQL, f"st.s * {WEIGHT!r} + e.score * {1 - WEIGHT!r}", None, "score", None)


@q("pair_fold_sum", SUM_FEED_SQL)
def _c8(spark, sf):
    res = C.pair_fold(signed(spark, sf), "score", C.sum_update(), order=("ts",) + ORDER)
    return res.select("actor1", "actor2", *ORDER, r6("value").alias("value"))


@q("pair_fold_weighted", WEIGHTED_SQL + f"""
SELECT actor1, actor2, k1, k2, k3, k4, {_sql_r6("s")} AS value FROM st""")
def _c9(spark, sf):
    res = C.pair_fold(signed(spark, sf), "score", C.weighted(WEIGHT), order=("ts",) + ORDER)
    return res.select("actor1", "actor2", *ORDER, r6("value").alias("value"))


@q("pair_fold_weighted_state", WEIGHTED_SQL + f"""
SELECT actor1, actor2, {_sql_r6("s")} AS value, rn AS n
FROM (SELECT *, row_number() OVER (PARTITION BY actor1, actor2 ORDER BY rn DESC) AS back FROM st) z
WHERE back = 1""")
def _c7(spark, sf):
    res = C.pair_fold(signed(spark, sf), "score", C.weighted(WEIGHT), order=("ts",) + ORDER, feed=False)
    return res.select("actor1", "actor2", r6("value").alias("value"), "n")


def sign_runs() -> Monoid:
    """Longest run of scores of one sign, as pieces that know their first and last run."""
    def lift(x):
        sign = F.signum(x).cast("int")
        one = F.lit(1).cast("long")
        return F.struct(one.alias("n"), sign.alias("first"), one.alias("head"), sign.alias("last"), one.alias("tail"), one.alias("best"))

    def merge(a, b):
        met = F.when(a["last"] == b["first"], a["tail"] + b["head"]).otherwise(F.lit(0).cast("long"))
        head = F.when((a["head"] == a["n"]) & (a["last"] == b["first"]), a["n"] + b["head"]).otherwise(a["head"])
        tail = F.when((b["tail"] == b["n"]) & (a["last"] == b["first"]), b["n"] + a["tail"]).otherwise(b["tail"])
        return F.struct((a["n"] + b["n"]).alias("n"), a["first"].alias("first"), head.alias("head"), b["last"].alias("last"), tail.alias("tail"),
                        F.greatest(a["best"], b["best"], met).alias("best"))
    return Monoid(lift, merge, lambda p: p["best"])


@q("pair_fold_monoid", f"""WITH e AS (SELECT actor1, actor2, CAST(sign(score) AS INTEGER) AS g,
    row_number() OVER (PARTITION BY actor1, actor2 ORDER BY ts, k1, k2, k3, k4) AS rn FROM ({SIGNED_SQL}) s),
  r AS (SELECT *, rn - row_number() OVER (PARTITION BY actor1, actor2, g ORDER BY rn) AS island FROM e),
  l AS (SELECT actor1, actor2, count(*) AS n FROM r GROUP BY actor1, actor2, g, island)
SELECT actor1, actor2, max(n) AS value, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY actor1, actor2""")
def _c7m(spark, sf):
    return C.pair_fold(signed(spark, sf), "score", sign_runs(), order=("ts",) + ORDER, feed=False)


@q("pair_fold_sequential", ORACLES["pair_fold_weighted_state"])
def _c7s(spark, sf):
    update = Sequential(lambda state, x: state * WEIGHT + x * (1 - WEIGHT))
    res = C.pair_fold(signed(spark, sf), "score", update, order=("ts",) + ORDER, feed=False)
    return res.select("actor1", "actor2", r6("value").alias("value"), "n")


@q("snapshot_counts", f"""WITH ev AS (
  SELECT actor1, actor2, COALESCE(epoch_ms(CAST(dateAdded AS TIMESTAMP)), -1) AS ts FROM ({PAIRS_SQL}) p
), req AS (SELECT DISTINCT epoch_ms(request_ts) AS r FROM ({fx.SNAPSHOT_REQUESTS_SQL}) q)
SELECT r AS request_ts, actor1, actor2, count(*) AS n
FROM req JOIN ev ON ev.ts <= req.r GROUP BY ALL""")
def _c10(spark, sf):
    feed = C.interaction_counts_feed(B.event_time_or(pairs(spark, sf)), order=("ts",) + ORDER)
    res = C.snapshot_at(fx.snapshot_requests(spark, sf), feed, "n", ts_col="ts", order=ORDER)
    return res.select("request_ts", "actor1", "actor2", "n")


# ------------------------------------------------------------- D operators

from relflow.operators import views as D  # noqa: E402

STATE_CTE = RELATION_FEED_SQL + """, state AS (
  SELECT actor1, actor2, s / nn AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY actor1, actor2 ORDER BY rn DESC) AS back FROM st) z
  WHERE back = 1
), mirrored AS (
  SELECT actor1, actor2, score FROM state
  UNION ALL SELECT actor2, actor1, score FROM state WHERE actor1 <> actor2
)"""


def relation_state(spark, sf) -> DataFrame:
    return C.relation_scores(signed(spark, sf), lam=LAM, order=ORDER).select("actor1", "actor2", "score")


@q("known_countries", STATE_CTE + f"""
SELECT actor1, actor2, {_sql_r6("score")} AS score FROM state
WHERE actor1 IN (SELECT country FROM ({fx.COUNTRIES_SQL}) c) AND actor2 IN (SELECT country FROM ({fx.COUNTRIES_SQL}) c)""")
def _d1(spark, sf):
    res = D.known_countries(relation_state(spark, sf), fx.countries(spark, sf))
    return res.select("actor1", "actor2", r6("score").alias("score"))


@q("mirror", STATE_CTE + f"""
SELECT actor1, actor2, {_sql_r6("score")} AS score FROM mirrored""")
def _d2(spark, sf):
    res = D.mirror(relation_state(spark, sf))
    return res.select("actor1", "actor2", r6("score").alias("score"))


@q("changes_only", RELATION_FEED_SQL + f""", f AS (
  SELECT actor1, actor2, k1, k2, k3, k4, ts, {_sql_r6("s / nn")} AS score FROM st
), g AS (
  SELECT *, lag(score) OVER (PARTITION BY actor1, actor2 ORDER BY ts, k1, k2, k3, k4) AS prev FROM f
)
SELECT actor1, actor2, k1, k2, k3, k4, score FROM g WHERE score IS DISTINCT FROM prev""")
def _d3(spark, sf):
    feed = C.relation_scores_feed(signed(spark, sf), lam=LAM, order=ORDER) \
            .withColumn("score", r6("score"))
    res = D.changes_only(feed, "score", order=("ts",) + ORDER)
    return res.select("actor1", "actor2", *ORDER, "score")


@q("country_mean", STATE_CTE + f"""
SELECT country, {_sql_r6("CASE WHEN m = 0 OR isnan(m) THEN 1.0 ELSE m END")} AS mean
FROM (SELECT actor1 AS country, avg(score) AS m FROM mirrored GROUP BY actor1) x""")
def _d4(spark, sf):
    res = D.country_mean(relation_state(spark, sf))
    return res.select("country", r6("mean").alias("mean"))


SELECTED = "NATION_3"


@q("relations_of", STATE_CTE + f"""
SELECT actor2 AS partner, {_sql_r6("score")} AS score FROM mirrored WHERE actor1 = '{SELECTED}'""")
def _d5(spark, sf):
    res = D.relations_of(relation_state(spark, sf), SELECTED)
    return res.select("partner", r6("score").alias("score"))


@q("relation_extent", STATE_CTE + f"""
SELECT actor1 AS country, {_sql_r6("min(score)")} AS lo, {_sql_r6("max(score)")} AS hi
FROM mirrored GROUP BY actor1""")
def _d6(spark, sf):
    res = D.relation_extent(relation_state(spark, sf))
    return res.select("country", r6("lo").alias("lo"), r6("hi").alias("hi"))


@q("relation_extent_feed", RELATION_FEED_SQL + f""", f AS (
  SELECT actor1, actor2, k1, k2, k3, k4, ts, s / nn AS score FROM st
), m AS (
  SELECT actor1 AS country, k1, k2, k3, k4, ts, score FROM f
  UNION ALL SELECT actor2, k1, k2, k3, k4, ts, score FROM f WHERE actor1 <> actor2
)
SELECT country, k1, k2, k3, k4,
  {_sql_r6("min(score) OVER (PARTITION BY country ORDER BY ts, k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS lo,
  {_sql_r6("max(score) OVER (PARTITION BY country ORDER BY ts, k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS hi
FROM m""")
def _d6f(spark, sf):
    feed = C.relation_scores_feed(signed(spark, sf), lam=LAM, order=ORDER)
    m = D.mirror(feed, extra=("ts",) + ORDER).withColumnRenamed("actor1", "country")
    res = D.relation_extent_feed(m, order=("ts",) + ORDER)
    return res.select("country", *ORDER, r6("lo").alias("lo"), r6("hi").alias("hi"))


HOUR_MS = 3600000
ACTIVITY_SQL = f"""WITH t AS (SELECT epoch_us(ts) // 1000 AS t FROM events WHERE ts IS NOT NULL),
t0 AS (SELECT min(t) AS t0 FROM t),
c AS (SELECT greatest(CAST(ceil((t - t0) / {HOUR_MS}.0) AS BIGINT) - 1, 0) AS bucket, count(*) AS n
      FROM t, t0 GROUP BY ALL),
lst AS (SELECT max(bucket) AS l FROM c),
series AS (
  SELECT g.bucket, t0.t0 + g.bucket * {HOUR_MS} AS t_start, COALESCE(c.n, 0) AS n
  FROM (SELECT range AS bucket FROM lst, range(greatest(l - 30, 0), l)) g
  LEFT JOIN c USING (bucket), t0
)"""


@q("activity_series", ACTIVITY_SQL + "\nSELECT bucket, t_start, n FROM series")
def _d7(spark, sf):
    return D.activity_series(fx.updates(spark, sf), HOUR_MS, keep=30)


@q("activity_summary", ACTIVITY_SQL + f"""
SELECT max(n) AS max_n, CAST(floor(avg(n) + 0.5) AS BIGINT) AS mean_n,
       {_sql_r6(f"CAST(floor(avg(n) + 0.5) AS BIGINT) * 1000.0 / {float(HOUR_MS)!r}")} AS rate_per_sec FROM series""")
def _d8(spark, sf):
    res = D.activity_summary(D.activity_series(fx.updates(spark, sf), HOUR_MS, keep=30), HOUR_MS)
    return res.select("max_n", "mean_n", r6("rate_per_sec").alias("rate_per_sec"))


@q("score_classes", STATE_CTE + f""", r AS (SELECT actor1, actor2, {_sql_r6("score")} AS score FROM state),
e AS (SELECT min(score) AS lo, max(score) AS hi FROM r)
SELECT actor1, actor2, score,
  CAST(CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((score - lo) / (hi - lo) * 9), 0), 8) END AS INTEGER) AS class
FROM r, e""")
def _d9(spark, sf):
    st = relation_state(spark, sf).withColumn("score", r6("score"))
    return D.score_classes(st, "score", 9).select("actor1", "actor2", "score", "class")


@q("nested_state", STATE_CTE + f"""
SELECT actor1, actor2, {_sql_r6("score")} AS score, count(*) OVER (PARTITION BY actor1) AS n_partners FROM state""")
def _d10(spark, sf):
    res = D.nested_state(relation_state(spark, sf)).withColumn("n_partners", F.size("relations").cast("long"))
    return res.select("actor1", "n_partners", F.explode("relations").alias("actor2", "score")) \
              .select("actor1", "actor2", r6("score").alias("score"), "n_partners")


# ------------------------------------------------------------- F operators

from relflow.functions import jrandom as JR  # noqa: E402
from relflow.operators import factors as FX  # noqa: E402
from relflow.operators import training as TR  # noqa: E402
from relflow.operators.meeting import stored  # noqa: E402
from relflow.session import scan_partitions  # noqa: E402
from relflow.sources.ids import assign_ordered_ids  # noqa: E402

K = 10
KV = 64          # dimension of the fixture vectors
LR = 0.01
NEG_SEED = 42
RATINGS = fx.RATINGS_SQL


def _rng_sql(name: str, ids_sql: str, k: int, lo: float = 0.0, hi: float = 1.0) -> str:
    """DuckDB replay of java.util.Random(id).nextDouble() x k, long format."""
    scale = "" if (lo, hi) == (0.0, 1.0) else f"{float(lo)!r} + {float(hi) - float(lo)!r} * "
    return f"""{name}_rng AS (
  SELECT id, 0 AS step, CAST(xor(CAST(id AS BIGINT), {JR.MULTIPLIER}) & {JR.MASK48} AS HUGEINT) AS s
  FROM ({ids_sql}) i
  UNION ALL
  SELECT id, step + 1, (s * {JR.MULTIPLIER} + {JR.ADDEND}) % {1 << 48} FROM {name}_rng WHERE step < {2 * k}
), {name} AS (
  SELECT a.id, CAST((a.step - 1) // 2 AS INTEGER) AS pos,
         {scale}(CAST((a.s // 4194304) * 134217728 + (b.s // 2097152) AS DOUBLE) / 9007199254740992.0) AS v
  FROM {name}_rng a JOIN {name}_rng b ON a.id = b.id AND b.step = a.step + 1 WHERE a.step % 2 = 1
)"""


def _long(df: DataFrame, id_col: str, out_id: str | None = None) -> DataFrame:
    return df.select(F.col(id_col).alias(out_id or id_col), F.posexplode("factors").alias("pos", "v")) \
             .select(out_id or id_col, "pos", r6("v").alias("v"))


def ratings(spark, sf):
    return fx.ratings(spark, sf)


RATED_USERS = f"SELECT DISTINCT user_id AS id FROM ({RATINGS}) r"
RATED_ITEMS = f"SELECT DISTINCT item_id AS id FROM ({RATINGS}) r"


@q("init_factors_ranged", "WITH RECURSIVE " + _rng_sql("iv", RATED_ITEMS, K, -1.0, 1.0) + f"""
SELECT id AS item_id, pos, {_sql_r6("v")} AS v FROM iv""")
def _f1(spark, sf):
    ids = ratings(spark, sf).select("item_id").distinct()
    return _long(FX.init_factors(ids, "item_id", FX.ranged_init(K, -1.0, 1.0)), "item_id")


@q("init_factors_seeded", "WITH RECURSIVE " + _rng_sql("uv", RATED_USERS, K) + f"""
SELECT id AS user_id, pos, {_sql_r6("v")} AS v FROM uv""")
def _f2(spark, sf):
    ids = ratings(spark, sf).select("user_id").distinct()
    return _long(FX.init_factors(ids, "user_id", FX.seeded_init(K)), "user_id")


@q("init_factors_random", f"""SELECT id AS item_id, CAST(p AS INTEGER) AS pos,
  {_sql_r6("CAST(CAST('0x' || substr(md5('7:' || id || ':' || p), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0")} AS v
FROM ({RATED_ITEMS}) i, generate_series(0, {K - 1}) g(p)""")
def _f3(spark, sf):
    ids = ratings(spark, sf).select("item_id").distinct()
    return _long(FX.init_factors(ids, "item_id", FX.random_init(K, seed=7)), "item_id")


def _mf_tables(spark, sf):
    r = stored(ratings(spark, sf))      # read for its users, its items and its pairs
    users = FX.init_factors(stored(r.select("user_id").distinct()), "user_id", FX.seeded_init(K))
    items = FX.init_factors(stored(r.select("item_id").distinct()), "item_id", FX.ranged_init(K, -1.0, 1.0))
    return r, users, items


MF_CTE = ("WITH RECURSIVE " + _rng_sql("uv", RATED_USERS, K) + ", " + _rng_sql("iv", RATED_ITEMS, K, -1.0, 1.0)
          + f", r AS (SELECT *, row_number() OVER () AS rid FROM ({RATINGS}) r0)")


@q("score_pairs", MF_CTE + f"""
SELECT r.k1, r.k2, r.user_id, r.item_id, {_sql_r6("sum(u.v * i.v)")} AS score
FROM r JOIN uv u ON u.id = r.user_id JOIN iv i ON i.id = r.item_id AND i.pos = u.pos
GROUP BY r.rid, r.k1, r.k2, r.user_id, r.item_id""")
def _f5(spark, sf):
    r, users, items = _mf_tables(spark, sf)
    res = FX.score_pairs(r.select("k1", "k2", "user_id", "item_id", "ts"), users, items)
    return res.select("k1", "k2", "user_id", "item_id", r6("score").alias("score"))


@q("vector_norms", f"""WITH x AS ({fx.ITEM_VECTORS_SQL})
SELECT item_id, {_sql_r6("list_sum(list_transform(factors, lambda v: v * v))")} AS sq_norm,
       {_sql_r6("sqrt(list_sum(list_transform(factors, lambda v: v * v)))")} AS norm FROM x""")
def _f6(spark, sf):
    res = FX.vector_norms(fx.item_vectors(spark, sf))
    return res.select("item_id", r6("sq_norm").alias("sq_norm"), r6("norm").alias("norm"))


@q("sgd_deltas", MF_CTE + f""", e AS (
  SELECT r.k1, r.k2, r.user_id, r.item_id, r.rating - sum(u.v * i.v) AS err
  FROM r JOIN uv u ON u.id = r.user_id JOIN iv i ON i.id = r.item_id AND i.pos = u.pos
  GROUP BY r.rid, r.k1, r.k2, r.user_id, r.item_id, r.rating
)
SELECT e.k1, e.k2, e.user_id, e.item_id, u.pos,
       {_sql_r6(f"i.v * ({LR!r} * e.err)")} AS du, {_sql_r6(f"u.v * ({LR!r} * e.err)")} AS dv
FROM e JOIN uv u ON u.id = e.user_id JOIN iv i ON i.id = e.item_id AND i.pos = u.pos""")
def _f9(spark, sf):
    r, users, items = _mf_tables(spark, sf)
    d = FX.sgd_deltas(r.select("k1", "k2", "user_id", "item_id", "ts", "rating"), users, items, LR)
    z = d.select("k1", "k2", "user_id", "item_id",
                 F.posexplode(F.arrays_zip("du", "dv")).alias("pos", "z"))
    return z.select("k1", "k2", "user_id", "item_id", "pos", r6(F.col("z.du")).alias("du"),
                    r6(F.col("z.dv")).alias("dv"))


# existing model = fixture vectors (64-dim); rated ids without a vector are initialised
STEP_CTE = ("WITH RECURSIVE " + _rng_sql("uinit", RATED_USERS, KV) + ", " + _rng_sql("iinit", RATED_ITEMS, KV)
            + f""", r AS ({RATINGS}),
eu AS (SELECT user_id AS id, CAST(generate_subscripts(factors, 1) - 1 AS INTEGER) AS pos, unnest(factors) AS v
       FROM ({fx.USER_VECTORS_SQL}) x),
ei AS (SELECT item_id AS id, CAST(generate_subscripts(factors, 1) - 1 AS INTEGER) AS pos, unnest(factors) AS v
       FROM ({fx.ITEM_VECTORS_SQL}) x),
pu AS (SELECT * FROM eu WHERE id IN (SELECT id FROM ({RATED_USERS}) a)
       UNION ALL SELECT * FROM uinit WHERE id NOT IN (SELECT id FROM eu)),
pi AS (SELECT * FROM ei WHERE id IN (SELECT id FROM ({RATED_ITEMS}) a)
       UNION ALL SELECT * FROM iinit WHERE id NOT IN (SELECT id FROM ei)),""")


def _step_body(ratings_cte: str) -> str:
    return f"""
e AS (
  SELECT q.user_id, q.item_id, q.rating - sum(u.v * i.v) AS err, q.rid
  FROM {ratings_cte} q JOIN pu u ON u.id = q.user_id JOIN pi i ON i.id = q.item_id AND i.pos = u.pos
  GROUP BY q.user_id, q.item_id, q.rating, q.rid
),
du AS (SELECT e.user_id AS id, i.pos, sum(i.v * ({LR!r} * e.err)) AS d
       FROM e JOIN pi i ON i.id = e.item_id GROUP BY ALL),
dv AS (SELECT e.item_id AS id, u.pos, sum(u.v * ({LR!r} * e.err)) AS d
       FROM e JOIN pu u ON u.id = e.user_id GROUP BY ALL),
nu AS (SELECT b.id, b.pos, b.v + COALESCE(du.d, 0.0) AS v
       FROM (SELECT * FROM eu UNION ALL SELECT * FROM pu WHERE id NOT IN (SELECT id FROM eu)) b
       LEFT JOIN du ON du.id = b.id AND du.pos = b.pos),
ni AS (SELECT b.id, b.pos, b.v + COALESCE(dv.d, 0.0) AS v
       FROM (SELECT * FROM ei UNION ALL SELECT * FROM pi WHERE id NOT IN (SELECT id FROM ei)) b
       LEFT JOIN dv ON dv.id = b.id AND dv.pos = b.pos)"""


STEP_SQL = STEP_CTE + " rr AS (SELECT user_id, item_id, rating, row_number() OVER () AS rid FROM r)," + _step_body("rr")


def _step_tables(spark, sf):
    r = ratings(spark, sf)
    users = fx.user_vectors(spark, sf)
    items = fx.item_vectors(spark, sf)
    return r, users, items


@q("apply_deltas", STEP_SQL + f"\nSELECT id AS item_id, pos, {_sql_r6('v')} AS v FROM ni")
def _f7(spark, sf):
    r, users, items = _step_tables(spark, sf)
    r = stored(r.select("user_id", "item_id", "rating"))
    pu = stored(FX.pull_or_init(r, users, "user_id", FX.seeded_init(KV)))
    pi = stored(FX.pull_or_init(r, items, "item_id", FX.seeded_init(KV)))
    d = FX.sgd_deltas(r.select("user_id", "item_id", "rating"), pu, pi, LR, sides=("item",))
    new_i = FX.apply_deltas(items, d.select("item_id", F.col("dv").alias("delta")), "item_id", FX.seeded_init(KV), k=KV)
    return _long(new_i, "item_id")


@q("pull_or_init", STEP_SQL + f"\nSELECT id AS user_id, pos, {_sql_r6('v')} AS v FROM pu")
def _f8(spark, sf):
    r, users, _ = _step_tables(spark, sf)
    return _long(FX.pull_or_init(r, users, "user_id", FX.seeded_init(KV)), "user_id")


@q("sgd_step", STEP_SQL + f"""
SELECT 'user' AS side, id, pos, {_sql_r6('v')} AS v FROM nu
UNION ALL SELECT 'item', id, pos, {_sql_r6('v')} FROM ni""")
def _f10(spark, sf):
    r, users, items = _step_tables(spark, sf)
    m = TR.sgd_step_model(r, users, items, LR, FX.seeded_init(KV), FX.seeded_init(KV), k=KV)
    return _long_sides(m)


def _long_sides(m: DataFrame) -> DataFrame:
    return m.select("side", "id", F.posexplode("factors").alias("pos", "v")) \
            .select("side", "id", "pos", r6("v").alias("v"))


@q("model_updates", STEP_SQL + f"""
SELECT 'user' AS side, id, CAST(1 AS INTEGER) AS step, pos, {_sql_r6('v')} AS v FROM nu WHERE id IN (SELECT id FROM ({RATED_USERS}) a)
UNION ALL SELECT 'item', id, 1, pos, {_sql_r6('v')} FROM ni WHERE id IN (SELECT id FROM ({RATED_ITEMS}) a)""")
def _f12(spark, sf):
    r, users, items = _step_tables(spark, sf)
    up = TR.step_updates(r, users, items, LR, FX.seeded_init(KV), FX.seeded_init(KV), step=1, k=KV)
    return up.select("side", "id", "step", F.posexplode("factors").alias("pos", "v")) \
             .select("side", "id", "step", "pos", r6("v").alias("v"))


REQUESTS_SQL = f"""SELECT row_number() OVER (ORDER BY k1, k2, item_id, user_id) - 1 AS request_id,
  user_id, item_id, k1, k2 FROM ({RATINGS}) r"""


def requests(spark, sf):
    return assign_ordered_ids(ratings(spark, sf), ["k1", "k2", "item_id", "user_id"], out="request_id")


@q("ordered_ids", f"SELECT request_id, k1, k2, item_id, user_id FROM ({REQUESTS_SQL}) x")
def _a4(spark, sf):
    return requests(spark, sf).select("request_id", "k1", "k2", "item_id", "user_id")


NEG_SQL = f"""req AS ({REQUESTS_SQL}),
items AS (SELECT item_id AS _item, row_number() OVER (ORDER BY item_id) - 1 AS ix
          FROM (SELECT DISTINCT item_id FROM ({RATINGS}) r) d),
mm AS (SELECT count(*) AS m FROM items),
rq AS (SELECT req.request_id, req.user_id, items.ix AS t_ix,
              mm.m - CASE WHEN items.ix IS NULL THEN 0 ELSE 1 END AS c
       FROM req LEFT JOIN items ON req.item_id = items._item, mm),
ex AS (SELECT request_id, t_ix, c, unnest(generate_series(1, least({9}, c))) AS j FROM rq WHERE c > 0),
hx AS (SELECT *, CAST(('0x' || substr(md5('{NEG_SEED}:' || request_id || ':' || j), 1, 15)) AS BIGINT) % c AS ix0 FROM ex),
neg AS (SELECT request_id, j, _item AS neg_item_id
        FROM (SELECT *, CASE WHEN t_ix IS NOT NULL AND ix0 >= t_ix THEN ix0 + 1 ELSE ix0 END AS ix FROM hx) x
        JOIN items USING (ix))"""


def negatives(spark, sf, req=None, keep=()):
    req = req if req is not None else requests(spark, sf)
    items = ratings(spark, sf).select("item_id").distinct()
    return TR.negative_samples(req, items, n=9, seed=NEG_SEED, keep=keep)


@q("negative_samples", "WITH " + NEG_SQL + "\nSELECT request_id, j, neg_item_id FROM neg")
def _f13(spark, sf):
    order = ["k1", "k2", "item_id", "user_id"]
    req = assign_ordered_ids(ratings(spark, sf).select(*order), order, out="request_id")
    return negatives(spark, sf, req).select("request_id", F.col("j").cast("long").alias("j"), "neg_item_id")


@q("train_step", STEP_CTE + NEG_SQL + """,
tq AS (SELECT user_id, item_id, CAST(1.0 AS DOUBLE) AS rating, request_id * 100 AS rid FROM req
       UNION ALL SELECT req.user_id, neg.neg_item_id, CAST(0.0 AS DOUBLE), neg.request_id * 100 + neg.j
       FROM neg JOIN req USING (request_id)),""" + _step_body("tq") + f"""
SELECT 'user' AS side, id, pos, {_sql_r6('v')} AS v FROM nu
UNION ALL SELECT 'item', id, pos, {_sql_r6('v')} FROM ni""")
def _f14(spark, sf):
    r, users, items = _step_tables(spark, sf)
    req = requests(spark, sf).select("request_id", "user_id", "item_id")      # stored in their order
    neg = negatives(spark, sf, req, keep=("user_id",))
    m = TR.train_step(req, neg, users, items, LR, FX.seeded_init(KV), FX.seeded_init(KV), k=KV)
    return _long_sides(m)


# ------------------------------------------------------------- G operators

from relflow.operators import evaluation as G  # noqa: E402
from relflow.operators import topk as TK  # noqa: E402

TOPK = 10
BUCKET = 10

ITEMS_LONG = f"""ivl AS (SELECT item_id, CAST(generate_subscripts(factors, 1) - 1 AS INTEGER) AS pos, unnest(factors) AS v
  FROM ({fx.ITEM_VECTORS_SQL}) x)"""
# every rated user: its vector in the model, or its initial one
USERS_LONG = f"""{_rng_sql("uinit", RATED_USERS, KV)},
eu AS (SELECT user_id AS id, CAST(generate_subscripts(factors, 1) - 1 AS INTEGER) AS pos, unnest(factors) AS v
       FROM ({fx.USER_VECTORS_SQL}) x),
uvl AS (SELECT id AS user_id, pos, v FROM eu WHERE id IN (SELECT id FROM ({RATED_USERS}) a)
        UNION ALL SELECT id, pos, v FROM uinit WHERE id NOT IN (SELECT id FROM eu))"""
BRUTE_SQL = f"""WITH RECURSIVE {USERS_LONG}, {ITEMS_LONG},
sc AS (SELECT u.user_id, i.item_id, sum(u.v * i.v) AS score FROM uvl u JOIN ivl i ON u.pos = i.pos GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id DESC) AS rank FROM sc)"""
TOPK_SQL = BRUTE_SQL + f"\nSELECT user_id, rank, item_id, {_sql_r6('score')} AS score FROM rk WHERE rank <= {TOPK}"


@q("length_buckets", f"""WITH {ITEMS_LONG},
nr AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM ivl GROUP BY item_id),
rk AS (SELECT *, row_number() OVER (ORDER BY norm DESC, item_id DESC) - 1 AS rank FROM nr),
bk AS (SELECT *, rank // {BUCKET} AS bucket FROM rk)
SELECT item_id, {_sql_r6('norm')} AS norm, rank, bucket,
  {_sql_r6(f'max(norm) OVER (PARTITION BY bucket)')} AS bucket_max,
  {_sql_r6(f'min(norm) OVER (PARTITION BY bucket)')} AS bucket_min FROM bk""")
def _g1(spark, sf):
    res = TK.length_buckets(fx.item_vectors(spark, sf), BUCKET)
    return res.select("item_id", r6("norm").alias("norm"), "rank", "bucket",
                      r6("bucket_max").alias("bucket_max"), r6("bucket_min").alias("bucket_min"))


def rated_users(spark, sf) -> DataFrame:
    """Every rated user with its vector. The users are found once; an initial vector is
    made where it is read, which costs less than a stored one."""
    ids = stored(ratings(spark, sf).select("user_id").distinct())
    # a stored id is small and its vector is not: no merging of partitions by the ids' bytes
    return FX.pull_or_init(ids.repartition(scan_partitions(spark), "user_id"), fx.user_vectors(spark, sf), "user_id", FX.seeded_init(KV))


def _topk_query(prune):
    def run(spark, sf):
        res = TK.top_k(rated_users(spark, sf), fx.item_vectors(spark, sf), TOPK, prune=prune,
                       bucket_size=BUCKET, n_focus=5, t=2.5)
        return res.select("user_id", "rank", "item_id", r6("score").alias("score"))
    return run


QUERIES["top_k"] = _topk_query(None)
ORACLES["top_k"] = TOPK_SQL
for _p in ("length", "coord", "incr", "lc", "li"):
    QUERIES[f"top_k_{_p}"] = _topk_query(_p)
    ORACLES[f"top_k_{_p}"] = TOPK_SQL


@q("focus_set", f"""WITH RECURSIVE {USERS_LONG},
r AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY v * v DESC, pos ASC) AS rank FROM uvl)
SELECT user_id, rank, pos AS coord FROM r WHERE rank <= 5""")
def _g7(spark, sf):
    fs = TK.focus_set(rated_users(spark, sf), 5)
    return fs.select("user_id", F.posexplode("focus").alias("rank", "coord")) \
             .select("user_id", (F.col("rank") + 1).cast("long").alias("rank"), "coord")


SHARDS = 3


@q("merge_top_k", TOPK_SQL)
def _g8(spark, sf):
    users, items = rated_users(spark, sf), fx.item_vectors(spark, sf)
    # partial lists from item shards, as separate workers would hold them
    parts = None
    for s in range(SHARDS):
        shard = items.filter(F.pmod(F.col("item_id"), F.lit(SHARDS)) == s)
        p = TK.top_k(users, shard, TOPK, prune="li", bucket_size=BUCKET)
        parts = p if parts is None else parts.unionByName(p)
    m = TK.merge_top_k(parts.withColumnRenamed("user_id", "request_id"), TOPK, target_col=None, ts_col=None)
    return m.select(F.col("request_id").alias("user_id"), F.col("rank").cast("long").alias("rank"),
                    "item_id", r6("score").alias("score"))


EVAL_SQL = f"""{BRUTE_SQL},
{REQUESTS_SQL.replace('SELECT row_number()', 'dummy AS (SELECT 1), req AS (SELECT row_number()', 1)}),
rq AS (SELECT req.*, epoch(o.o_orderdate) AS ts FROM req JOIN orders o ON o.o_orderkey = req.k1),
ev AS (SELECT rq.request_id, rq.ts,
         COALESCE(1.0 / (log2(CAST(rk.rank AS DOUBLE)) + 1.0), 0.0) AS ndcg
       FROM rq LEFT JOIN rk ON rk.user_id = rq.user_id AND rk.item_id = rq.item_id AND rk.rank <= {TOPK})"""


def evaluations(spark, sf):
    req = requests(spark, sf).withColumn("ts", F.unix_timestamp(F.col("ts").cast("timestamp")))
    ranked = TK.top_k(rated_users(spark, sf), fx.item_vectors(spark, sf), TOPK, prune="li", bucket_size=BUCKET)
    return G.ndcg(ranked, req)


@q("ndcg", EVAL_SQL + f"\nSELECT request_id, {_sql_r6('ndcg')} AS ndcg FROM ev")
def _g9(spark, sf):
    return evaluations(spark, sf).select("request_id", r6("ndcg").alias("ndcg"))


@q("daily_ndcg", EVAL_SQL + f"""
SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n, {_sql_r6('avg(ndcg)')} AS mean_ndcg FROM ev GROUP BY ALL""")
def _g11(spark, sf):
    res = G.daily_ndcg(evaluations(spark, sf))
    return res.select("day", "n", r6("mean_ndcg").alias("mean_ndcg"))


GAP = 2 * 86400


@q("daily_ndcg_sessions", EVAL_SQL + f""",
tt AS (SELECT DISTINCT CAST(ts AS BIGINT) AS t FROM ev),
st AS (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NULL OR t - lag(t) OVER (ORDER BY t) > {GAP} THEN t END AS s FROM tt),
ss AS (SELECT t, last_value(s IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM st)
SELECT ss.session_start, CAST(floor(ev.ts / 86400) AS BIGINT) AS day, count(*) AS n, {_sql_r6('avg(ndcg)')} AS mean_ndcg
FROM ev JOIN ss ON ss.t = CAST(ev.ts AS BIGINT) GROUP BY ALL""")
def _g12(spark, sf):
    ev = evaluations(spark, sf).withColumn("t", F.col("ts"))
    res = G.daily_ndcg_sessions(ev, GAP, time_col="t", ts_col="ts")
    return res.select("session_start", "day", "n", r6("mean_ndcg").alias("mean_ndcg"))


@q("recommend", f"""{BRUTE_SQL}
SELECT user_id, rank, item_id, {_sql_r6('score')} AS score FROM rk
WHERE rank <= {TOPK} AND user_id IN (SELECT DISTINCT user_id FROM ({RATINGS}) r)""")
def _g13(spark, sf):
    res = TK.recommend(ratings(spark, sf), rated_users(spark, sf), fx.item_vectors(spark, sf), TOPK)
    return res.select("user_id", "rank", "item_id", r6("score").alias("score"))


# ------------------------------------------------- iterative (rows-only checks)

from relflow.operators import mf as MF  # noqa: E402
from relflow.streaming import training as ST  # noqa: E402


@q("train_mf")
def _f11(spark, sf):
    """DSGD over all ratings, reference defaults (10 factors, lr 0.01, +-0.01 init)."""
    r = ratings(spark, sf).select("user_id", "item_id", "rating", "ts", "k1", "k2")
    users, items = MF.train_mf(r, k=K, lr=LR, order=("ts", "k1", "k2"))
    return _long(users, "user_id", "id").withColumn("side", F.lit("user")).unionByName(
        _long(items, "item_id", "id").withColumn("side", F.lit("item")))


@q("prequential_eval")
def _g10(spark, sf):
    """Test-then-train over four time slices of all rating requests
    (reference defaults: K 100, lr 0.4, 9 negatives, 10 factors)."""
    r = ratings(spark, sf).withColumn("ts", F.unix_timestamp(F.col("ts").cast("timestamp")))
    req = assign_ordered_ids(r, ["ts", "k1", "k2", "item_id", "user_id"], out="request_id")
    ev = ST.prequential_eval(req, k=100, lr=0.4, n_neg=9, seed=NEG_SEED, factors=K, slices=4)
    return ev.select("request_id", "user_id", "item_id", "ts", r6("ndcg").alias("ndcg"))


# ------------------------------------- sources, sinks, streams (own module)

from relflow import io_queries  # noqa: E402, F401
