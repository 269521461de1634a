"""Continuously running keyed pair state (C11) and windowed counts (C3 stream).

Keyed state lives in the checkpointed state store (RocksDB) of a
``transformWithStateInPandas`` query: one ``ValueState`` per pair. Within a
micro-batch a pair's rows are folded in ``(ts, order)`` order; across
micro-batches rows arrive in arrival order, so a late row (earlier ``ts``
than the pair's last one) is handled by the ``late`` policy:

* ``"reference"``: ``dt < 0`` is used as is - the decay factor exceeds 1 and
  the last time moves back, exactly as the reference does (a NaN from
  ``0 * inf`` is reset to 0 before the clamp);
* ``"no_decay"``: ``dt`` is floored at 0 and the last time never moves back.

A pair's rows of one micro-batch are folded as composed clamp maps (one
vectorised scan); the exact per-row loop runs only when a non-finite value
could appear (the reference's NaN reset after a huge time jump back).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from relflow.fixtures import EVENT_ORDER
from relflow.functions import clampmap as cm

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIR = ("actor1", "actor2")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _decayed(prev: float, factor: float, bound: float) -> float:
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.float64(prev) * np.float64(factor)
    if np.isnan(x):
        return 0.0
    return float(min(max(x, -bound), bound))


class RelationScoreProcessor(StatefulProcessor):
    """State ``(score, norm, last_ts)`` per pair; emits one change per row."""

    def __init__(self, lam: float, bound: float, late: str, ts_col: str, score_col: str, order, out_cols):
        self.lam, self.bound, self.late = lam, bound, late
        self.ts_col, self.score_col, self.order, self.out_cols = ts_col, score_col, list(order), out_cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pair", "score double, norm double, last_ts long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.ts_col] + self.order, kind="stable")
        ts = pdf[self.ts_col].to_numpy(dtype=np.int64)
        xs = pdf[self.score_col].to_numpy(dtype=np.float64)
        if self.state.exists():
            s, n, t = self.state.get()
        else:
            s, n, t = 0.0, 0.0, int(ts[0])
        fast = self._fold_vectorised(ts, xs, s, n, t)
        if fast is not None:
            raw, nrm, (s, n, t) = fast
        else:
            raw, nrm, (s, n, t) = self._fold_loop(ts, xs, s, n, t)
        self.state.update((float(s), float(n), int(t)))
        out = pdf[[c for c in self.out_cols if c in pdf.columns]].copy()
        out["raw_score"] = raw
        out["norm"] = nrm
        out["score"] = raw / nrm
        yield out

    def _fold_vectorised(self, ts, xs, s, n, t):
        """The batch's rows of one pair as composed clamp maps (one log-step
        scan) applied to the stored state; None when a non-finite value could
        appear (then the exact loop runs, with the reference's NaN reset)."""
        prev_t = np.empty(len(ts), dtype=np.int64)
        prev_t[0] = t
        if self.late == "reference":
            prev_t[1:] = ts[:-1]
            last = int(ts[-1])
        else:
            run = np.maximum.accumulate(np.maximum(ts, t))
            prev_t[1:] = run[:-1]
            last = int(run[-1])
        dt = (ts - prev_t).astype(np.float64)
        if self.late == "no_decay":
            dt = np.maximum(dt, 0.0)
        with np.errstate(over="ignore"):
            a = np.exp(-self.lam * dt)
        if not np.all(np.isfinite(a)) or a.max() > 1e150:
            return None
        b, bound = self.bound, np.zeros(len(ts))
        seg = np.zeros(len(ts), dtype=np.int64)
        ps = cm.segmented_scan_np((a, xs, xs - b, xs + b), seg)
        pn = cm.segmented_scan_np((a, bound + 1.0, bound + 1.0 - b, bound + 1.0 + b), seg)
        raw = cm.apply_np(ps, np.float64(s))
        nrm = cm.apply_np(pn, np.float64(n))
        if not (np.all(np.isfinite(raw)) and np.all(np.isfinite(nrm))):
            return None
        return raw, nrm, (float(raw[-1]), float(nrm[-1]), last)

    def _fold_loop(self, ts, xs, s, n, t):
        raw = np.empty(len(ts))
        nrm = np.empty(len(ts))
        for i in range(len(ts)):
            dt = int(ts[i]) - t
            if self.late == "no_decay" and dt < 0:
                dt = 0
            with np.errstate(over="ignore"):
                f = float(np.exp(-self.lam * dt))
            s = _decayed(s, f, self.bound) + float(xs[i])
            n = _decayed(n, f, self.bound) + 1.0
            t = int(ts[i]) if self.late == "reference" else max(t, int(ts[i]))
            raw[i], nrm[i] = s, n
        return raw, nrm, (s, n, t)

    def close(self) -> None:
        pass


class CountProcessor(StatefulProcessor):
    """State ``n`` per pair; emits the running count per row."""

    def __init__(self, order, out_cols):
        self.order, self.out_cols = list(order), out_cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        n0 = self.state.get()[0] if self.state.exists() else 0
        out = pdf[[c for c in self.out_cols if c in pdf.columns]].copy()
        out["n"] = n0 + np.arange(1, len(pdf) + 1, dtype=np.int64)
        self.state.update((int(out["n"].iat[-1]),))
        yield out

    def close(self) -> None:
        pass


def stream_relation_scores(events: DataFrame, lam: float = 8e-10, bound: float = 100.0,
                           late: str = "reference", ts_col: str = "ts", score_col: str = "score",
                           order=EVENT_ORDER, keys=PAIR) -> DataFrame:
    """C4 as a streaming query in Update mode: one change row per event with
    ``raw_score, norm, score``. Input rows need ``keys, ts (ms), order, score``."""
    use_rocksdb(events.sparkSession)
    keep = list(keys) + [ts_col] + [o for o in order if o not in keys]
    sch = events.schema
    fields = [sch[c] for c in keep] + [T.StructField("raw_score", T.DoubleType()),
                                        T.StructField("norm", T.DoubleType()),
                                        T.StructField("score", T.DoubleType())]
    proc = RelationScoreProcessor(lam, bound, late, ts_col, score_col, order, keep)
    return events.select(*keep, score_col).groupBy(*keys).transformWithStateInPandas(
        proc, T.StructType(fields), "Update", "None")


def stream_counts(events: DataFrame, order=EVENT_ORDER, keys=PAIR) -> DataFrame:
    """C1 as a streaming query: running count per pair, one row per event."""
    use_rocksdb(events.sparkSession)
    keep = list(keys) + [o for o in order if o not in keys]
    fields = [events.schema[c] for c in keep] + [T.StructField("n", T.LongType())]
    return events.select(*keep).groupBy(*keys).transformWithStateInPandas(
        CountProcessor(order, keep), T.StructType(fields), "Update", "None")


class ChangedProcessor(StatefulProcessor):
    """State: the last value per pair; passes on the rows whose value is another."""

    def __init__(self, order, value):
        self.order, self.value = list(order), value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        v = pdf[self.value].to_numpy(dtype=np.float64)
        before = np.empty(len(v))
        before[1:] = v[:-1]
        known = self.state.exists()
        before[0] = self.state.get()[0] if known else 0.0
        same = (v == before) | (np.isnan(v) & np.isnan(before))
        same[0] &= known
        self.state.update((float(v[-1]),))
        yield pdf[~same]

    def close(self) -> None:
        pass


def stream_changes_only(feed: DataFrame, value: str = "score", order=("ts",) + EVENT_ORDER, keys=PAIR) -> DataFrame:
    """D3 as a streaming query: rows whose value differs from the pair's previous
    one, over all micro-batches."""
    use_rocksdb(feed.sparkSession)
    keep = list(dict.fromkeys([*keys, *order, value]))
    rows = feed.select(*keep)
    return rows.groupBy(*keys).transformWithStateInPandas(ChangedProcessor(order, value), rows.schema, "Update", "None")


def stream_counts_windowed(events: DataFrame, width: str = "5 seconds", ts_col: str = "ts",
                           keys=PAIR, delay: str = "0 seconds", weight: str | None = None) -> DataFrame:
    """C3 as a streaming query: event-time tumbling counts per pair (``weight``: sums
    of that column, such as the number of interactions of a row) with a watermark of ``max event time - delay`` (zero lateness by default), append
    mode - a window is emitted once the watermark passes its end."""
    t = F.col(ts_col)
    d = events.filter(t.isNotNull() & (t >= 0)).withColumn("_et", F.timestamp_millis(t))
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    return (d.withWatermark("_et", delay)
             .groupBy(F.window("_et", width).alias("w"), *keys)
             .agg(n.alias("n"))
             .select(*keys, F.unix_millis(F.col("w.start")).alias("window_start"),
                     F.unix_millis(F.col("w.end")).alias("window_end"), "n"))
