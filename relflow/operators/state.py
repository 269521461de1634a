"""Relation and interaction state per unordered pair (batch forms, C1-C10).

All ordered per-pair state runs through the skew-safe ordered scan / fold of
``relflow.plans.ordered_scan``; order-free state is a plain aggregation with
map-side partial aggregation.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relflow.fixtures import EVENT_ORDER
from relflow.operators.folds import Monoid, Sequential, monoid_fold, sequential_fold
from relflow.plans.ordered_scan import Channel, ordered_fold, ordered_scan
from relflow.sources.ids import assign_ordered_ids

PAIR = ("actor1", "actor2")
# Fixed value of the reference: decay per millisecond (half-life about 10 days).
DEFAULT_LAMBDA = 8e-10
# Fixed value of the reference: clamp bound of the decayed score and norm.
DEFAULT_BOUND = 100.0


# ------------------------------------------------------------------ counts

def interaction_counts_feed(df: DataFrame, order=EVENT_ORDER, keys=PAIR, keep=()) -> DataFrame:
    """Running interaction count per pair, one change row per event."""
    ch = Channel("n", a=F.lit(1.0), b=F.lit(1.0))
    res = ordered_scan(df, list(keys), list(order), [ch], keep=list(keep))
    return res.withColumn("n", F.col("n").cast("long"))


def interaction_counts(df: DataFrame, keys=PAIR) -> DataFrame:
    """Full state of C1 (C2): every pair with its count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def interaction_counts_windowed(df: DataFrame, width: str = "5 seconds", ts_col: str = "ts",
                                keys=PAIR, weight: str | None = None) -> DataFrame:
    """Event-time tumbling count per pair (C3). ``ts_col`` is epoch ms; rows
    without a time (null or -1) are dropped. Window bounds are output in ms."""
    t = F.col(ts_col)
    d = df.filter(t.isNotNull() & (t >= 0)).withColumn("_et", F.timestamp_millis(t))
    w = F.col(weight) if weight else F.lit(1)
    return (d.groupBy(F.window("_et", width).alias("w"), *keys)
             .agg(F.sum(w).cast("long").alias("n"))
             .select(*keys, F.unix_millis(F.col("w.start")).alias("window_start"),
                     F.unix_millis(F.col("w.end")).alias("window_end"), "n"))


# ------------------------------------------------------------ relation score

def _relation_channels(x: Column, bound: float):
    s = Channel("raw_score", a=F.lit(1.0), b=x, lo=x - F.lit(bound), hi=x + F.lit(bound), init=0.0)
    nrm = Channel("norm", a=F.lit(1.0), b=F.lit(1.0), lo=F.lit(1.0 - bound), hi=F.lit(1.0 + bound), init=0.0)
    return [s, nrm]


def relation_scores_feed(df: DataFrame, lam: float = DEFAULT_LAMBDA, bound: float = DEFAULT_BOUND,
                         ts_col: str = "ts", score_col: str = "score", order=EVENT_ORDER,
                         keys=PAIR, keep=()) -> DataFrame:
    """Per event, per pair (C4)::

        S <- clamp(S * exp(-lam*dt), -bound, bound) + x
        N <- clamp(N * exp(-lam*dt), -bound, bound) + 1
        emit S / N

    ``dt`` = ms since the pair's previous event (0 for its first). Rows are in
    ``(ts, order...)`` order. Output: keys, ts, order, keep, raw_score, norm, score.
    """
    chans = _relation_channels(F.col(score_col), bound)
    res = ordered_scan(df, list(keys), [ts_col] + list(order), chans, keep=list(keep),
                       time_col=ts_col, lam=lam)
    return res.withColumn("score", F.col("raw_score") / F.col("norm"))


def relation_scores(df: DataFrame, lam: float = DEFAULT_LAMBDA, bound: float = DEFAULT_BOUND,
                    ts_col: str = "ts", score_col: str = "score", order=EVENT_ORDER,
                    keys=PAIR) -> DataFrame:
    """State after all events (C5): ``actor1, actor2, raw_score, norm,
    score = raw/norm, last_ts, n``. Skew-safe: a hot pair is folded in pieces
    over range partitions and the pieces composed."""
    chans = _relation_channels(F.col(score_col), bound)
    res = ordered_fold(df, list(keys), [ts_col] + list(order), chans, time_col=ts_col, lam=lam)
    return res.select(*keys, "raw_score", "norm", (F.col("raw_score") / F.col("norm")).alias("score"),
                      F.col("t_last").cast("long").alias("last_ts"), "n")


# ------------------------------------------------ C6: JVM-only tree of pieces

_MAP_FIELDS = ("a", "sb", "sl", "sh", "nb", "nl", "nh")


def _event_piece(x: Column, t: Column, order_cols, bound: float) -> Column:
    """One event as a piece: sort key ``(t0, order...)``, its two maps
    (score, norm; ``a = 1`` since the decay is applied when composing), count."""
    return F.struct(
        t.cast("double").alias("t0"),
        *[F.col(o).cast("long").alias(f"o{i}") for i, o in enumerate(order_cols)],
        t.cast("double").alias("tl"), F.lit(1.0).alias("a"),
        x.alias("sb"), (x - F.lit(bound)).alias("sl"), (x + F.lit(bound)).alias("sh"),
        F.lit(1.0).alias("nb"), F.lit(1.0 - bound).alias("nl"), F.lit(1.0 + bound).alias("nh"),
        F.lit(1).cast("long").alias("n"))


def _piece(t0, o, tl, maps, n) -> Column:
    return F.struct(t0.alias("t0"), o.cast("long").alias("o"), tl.alias("tl"),
                    *[m.alias(nm) for nm, m in zip(_MAP_FIELDS, maps)], n.alias("n"))


def _compose_pieces(acc: Column, e: Column, lam: float) -> Column:
    """``e`` after ``acc``; ``e``'s first map is decayed by the gap between them."""
    from relflow.functions.clampmap import compose_col
    ga = e["a"] * F.exp(F.lit(-lam) * (e["t0"] - acc["tl"]))
    s = compose_col((ga, e["sb"], e["sl"], e["sh"]), (acc["a"], acc["sb"], acc["sl"], acc["sh"]))
    nn = compose_col((ga, e["nb"], e["nl"], e["nh"]), (acc["a"], acc["nb"], acc["nl"], acc["nh"]))
    return _piece(acc["t0"], acc["o"], e["tl"], (s[0], s[1], s[2], s[3], nn[1], nn[2], nn[3]),
                  acc["n"] + e["n"])


def _fold_group(items: Column, lam: float, o: Column) -> Column:
    """Sort a group's pieces by their sort key and fold them in order; the
    result is one piece with sort key ``(t0 of the first, o)``."""
    arr = F.array_sort(items)
    f = arr.getItem(0)
    init = _piece(f["t0"], o, f["tl"], tuple(f[m] for m in _MAP_FIELDS), f["n"])
    return F.aggregate(F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 1, F.lit(0))), init, lambda acc, e: _compose_pieces(acc, e, lam))


def relation_scores_by_day(df: DataFrame, lam: float = DEFAULT_LAMBDA, bound: float = DEFAULT_BOUND,
                           ts_col: str = "ts", score_col: str = "score", order=EVENT_ORDER,
                           fanout: int = 16384, keys=PAIR) -> DataFrame:
    """C5 computed as a JVM-only tree of piece folds (C6); same result.

    An event is the map ``S -> clamp(a*S + x, x-bound, x+bound)``; maps compose,
    so a pair's event sequence is folded bottom-up in contiguous pieces:
    level 0 groups events by ``(pair, ts, order[0] div fanout)``; each next
    level divides the piece index by ``fanout`` again until one piece per
    ``(pair, ts)`` is left, then pieces are grouped by ``ts div fanout^k``
    until one piece per pair is left. No group holds more than ``fanout``
    pieces (level 0: ``fanout`` ids, times the rows that share one id), so a
    hot pair or a hot day never lands in one task. The levels of ids, and those of
    times, are taken only where a ``(pair, ts)`` has more than ``fanout`` events, or a
    pair more than ``fanout`` times. ``order[0]`` must be an
    integer event id (the leading tie-break after ``ts``).
    """
    x = F.col(score_col)
    t = F.col(ts_col).cast("long")
    keys = list(keys)
    order_cols = list(order)
    base = df.select(*keys, t.alias("_t"), F.col(order_cols[0]).cast("long").alias("_id"),
                     _event_piece(x, t, order_cols, bound).alias("p"))
    # rows of a (pair, ts) and pieces of a pair: a level that bounds no group is left out
    sizes = base.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    sizes = sizes.groupBy(*keys).agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_m"), F.min("_lo").alias("_lo"),
                                     F.max("_hi").alias("_hi"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    rows, pieces, lo_id, hi_id, t_min, t_max = sizes.agg(F.max("_n"), F.max("_m"), F.min("_lo"), F.max("_hi"),
                                                         F.min("_t0"), F.max("_t1")).first()
    # pieces are counted from the smallest id and time, with whole numbers: the index reaches 0
    def up(c: str, least: int = 0) -> Column:
        return F.expr(f"({c} - ({least})) div {fanout}")

    cur = base
    if (rows or 0) > fanout:
        b = up("_id", lo_id or 0)
        cur = base.groupBy(*keys, "_t", b.alias("_b")).agg(
            _fold_group(F.collect_list("p"), lam, F.col("_b")).alias("p"))
        top = ((hi_id or 0) - (lo_id or 0)) // fanout
        while top:
            top //= fanout
            nb = up("_b")
            cur = cur.groupBy(*keys, "_t", nb.alias("_nb")).agg(
                _fold_group(F.collect_list("p"), lam, F.col("_nb")).alias("p")).withColumnRenamed("_nb", "_b")
    # one piece per (pair, ts); climb over time
    cur = cur.groupBy(*keys, "_t").agg(_fold_group(F.collect_list("p"), lam, F.col("_t")).alias("p")) \
             .select(*keys, (F.col("_t") - F.lit(t_min or 0)).alias("_b"), "p")
    top = (t_max or 0) - (t_min or 0) if (pieces or 0) > fanout else 0
    while top:
        top //= fanout
        nb = up("_b")
        cur = cur.groupBy(*keys, nb.alias("_nb")).agg(
            _fold_group(F.collect_list("p"), lam, F.col("_nb")).alias("p")).withColumnRenamed("_nb", "_b")
    cur = cur.groupBy(*keys).agg(_fold_group(F.collect_list("p"), lam, F.lit(0)).alias("p"))
    from relflow.functions.clampmap import apply_col
    p = F.col("p")
    raw = apply_col((p["a"], p["sb"], p["sl"], p["sh"]), F.lit(0.0))
    nrm = apply_col((p["a"], p["nb"], p["nl"], p["nh"]), F.lit(0.0))
    return cur.select(*keys, raw.alias("raw_score"), nrm.alias("norm"), (raw / nrm).alias("score"),
                      p["tl"].cast("long").alias("last_ts"), p["n"].alias("n"))


# ------------------------------------------------------------ generic folds

def sum_update() -> tuple:
    return ("sum",)


def weighted(w: float) -> tuple:
    return ("weighted", float(w))


def update_channel(update, x: Column, name: str = "value") -> Channel:
    """Channel of a built-in update: ``sum`` (C8) or ``weighted(w)``.
    Both keep the first value as is (``0 + x`` for sums; ``S0 = x0`` for the
    weighted map, since ``w*x0 + (1-w)*x0 = x0``)."""
    kind = update[0]
    if kind == "sum":
        return Channel(name, a=F.lit(1.0), b=x, init=0.0)
    if kind == "weighted":
        w = float(update[1])
        return Channel(name, a=F.lit(w), b=x * F.lit(1.0 - w), init="first", first=x)
    raise ValueError(f"update: {update}")


def pair_fold(df: DataFrame, value: str, update, keys=PAIR, order=EVENT_ORDER, keep=(),
              feed: bool = True) -> DataFrame:
    """Generic keyed fold (C7): the first value of a key is stored as is, later
    values become ``update(old, new)``; emits the new value per row (``feed``,
    column ``value``) or the final value per key (columns ``keys, value, n``),
    whatever the update.

    ``update``: ``sum_update()`` (C8), ``weighted(w)`` (C9) - both run as the
    skew-safe ordered scan - or a Python callable ``(old, new) -> float``.
    A callable is an arbitrary sequential function, so its keys cannot be cut:
    rows are hash-partitioned by key, sorted, and streamed batch by batch
    through it (memory stays bounded; a hot key costs time in one task). With
    ``feed=False`` also a ``folds.Monoid`` (skew-safe tree) or a ``folds.Sequential``
    of Spark expressions.
    """
    if isinstance(update, (Monoid, Sequential)):
        if feed:
            raise ValueError("folds of Spark expressions give the final value per key: feed=False")
        fold = monoid_fold if isinstance(update, Monoid) else sequential_fold
        return fold(df, value, update, keys, order)
    if callable(update):
        return _python_fold(df, value, update, list(keys), list(order), list(keep), feed)
    ch = update_channel(update, F.col(value).cast("double"))
    if feed:
        return ordered_scan(df, list(keys), list(order), [ch], keep=list(dict.fromkeys(list(keep) + [value])))
    return ordered_fold(df, list(keys), list(order), [ch]).select(*keys, "value", "n")


def _python_fold(df, value, update: Callable, keys, order, keep, feed):
    cols = list(dict.fromkeys(keys + order + keep + [value]))
    base = df.select(*cols)
    parts = base.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*(keys + order))
    out_fields = [base.schema[c] for c in cols if c != "value"] + [T.StructField("value", T.DoubleType())]
    schema = T.StructType(out_fields) if feed else T.StructType(
        [base.schema[k] for k in keys] + [T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())])

    def fn(it):
        cur_key, cur, n = None, None, 0
        for pdf in it:
            if len(pdf) == 0:
                continue
            ks = list(zip(*[pdf[k].tolist() for k in keys]))
            vals = pdf[value].to_numpy(dtype=np.float64)
            states = np.empty(len(pdf))
            last_rows = []
            for i, k in enumerate(ks):
                if k != cur_key:
                    if cur_key is not None and not feed:
                        last_rows.append(cur_key + (cur, n))
                    cur_key, cur, n = k, float(vals[i]), 1
                else:
                    cur, n = float(update(cur, float(vals[i]))), n + 1
                states[i] = cur
            if feed:
                pdf = pdf.copy()
                pdf["value"] = states
                yield pdf
            elif last_rows:
                yield pd.DataFrame(last_rows, columns=keys + ["value", "n"])
        if not feed and cur_key is not None:
            yield pd.DataFrame([cur_key + (cur, n)], columns=keys + ["value", "n"])

    return parts.mapInPandas(fn, schema)


# ------------------------------------------------------------ snapshots

def snapshot_at(requests: DataFrame, feed: DataFrame, value: str, ts_col: str = "ts",
                request_col: str = "request_ts", keys=PAIR, order=EVENT_ORDER) -> DataFrame:
    """For each snapshot request: every pair's state as of that moment.

    ``feed`` has one row per change (``keys, ts_col (ms), order, value``); a
    request at time r sees, per pair, the last change with ``ts <= r``
    (in ``(ts, order)`` order). Output: ``request_ts (ms), keys, value``.

    Plan: requests and changes are ordered by time, from late to early, in one
    ordered scan that hands each change the first request at or after it; the
    last change per (pair, request) is a partial aggregation (``max_by``); each
    such row then stands for every request up to the pair's next change
    (``explode(sequence)``).
    """
    req = (requests.select(F.unix_millis(F.col(request_col).cast("timestamp")).alias("r"))
           .filter(F.col("r").isNotNull()).distinct())
    req = assign_ordered_ids(req, ["r"], out="ri").checkpoint()
    w = feed.select(*keys, F.col(ts_col).cast("long").alias("_t"),
                    *[F.col(o) for o in order], F.col(value).alias("_v"))
    # a request comes before the changes of its own millisecond
    mark = req.select(F.col("r").alias("_t"), F.col("ri").alias("_ri")).withColumn("_late", F.lit(0))
    both = w.withColumn("_late", F.lit(1)).unionByName(mark, allowMissingColumns=True)
    both = both.withColumn("_g", F.lit(0)).withColumn("_back", -F.col("_t"))
    ahead = Channel("_next", a=F.when(F.col("_ri").isNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
                    b=F.coalesce(F.col("_ri").cast("double"), F.lit(0.0)), lo=F.lit(float("-inf")), hi=F.lit(float("inf")), init=-1.0)
    assigned = ordered_scan(both, ["_g"], ["_back", "_late"], [ahead], keep=[*keys, "_t", *order, "_v", "_ri"])
    assigned = assigned.filter(F.col("_ri").isNull() & (F.col("_next") >= 0)).withColumn("ri", F.col("_next").cast("long"))
    last = assigned.groupBy(*keys, "ri").agg(
        F.max_by("_v", F.struct(F.col("_t"), *[F.col(o) for o in order])).alias("_v"))
    nxt = F.lead("ri").over(Window.partitionBy(*keys).orderBy("ri"))
    m = req.agg(F.max("ri")).first()[0]
    spread = last.withColumn("_next", F.coalesce(nxt, F.lit((m if m is not None else -1) + 1))) \
                 .select(*keys, "_v", F.explode(F.sequence(F.col("ri"), F.col("_next") - 1)).alias("ri"))
    return spread.join(req, "ri").select(F.col("r").alias("request_ts"), *keys, F.col("_v").alias(value))
