"""Skew-safe ordered folds and scans per key.

An ordered fold per key (running count, decayed score, last value, ...) is,
written naively, a window or a ``collect_list`` over the key: one task then
holds the whole key, and a key may hold a third of all rows. Here the fold is
written as a fold of clamped affine maps (``relflow.functions.clampmap``), which
compose associatively, and run in three steps:

1. ``repartitionByRange(keys + order)``: balanced partitions whatever the key
   skew - a hot key is cut into contiguous pieces over many partitions - then
   one vectorised pass per partition (``mapInPandas``) folds each piece
   (a *run* = rows of one key inside one partition).
2. Only a partition's first and last run can continue in a neighbouring
   partition; every other run is a whole key, finished in place by a JVM
   expression (no shuffle of the runs). The at most ``2 * partitions`` edge
   runs are folded per key in partition order.
3. (scans only) Each row of an edge run gets the state carried into its run
   from a carry table of at most ``2 * partitions`` rows - a broadcast with a
   proven bound - and every row applies its prefix map, a JVM expression.

Scans materialise step 1 with a reliable ``checkpoint()`` into the cluster's
checkpoint folder, so that step 3 joins exactly the rows and partition ids of
step 1 (a recomputed range shuffle could sample different bounds) and no
lineage back to the source is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.functions import clampmap as cm
from relflow.session import checkpoint_dir, scan_partitions

INF = float("inf")


@dataclass
class Channel:
    """One folded quantity: per-row map ``S -> clamp(a*S + b, lo, hi)``.

    ``init`` is the state before the first row of a key (a float), or
    ``"first"`` to start from the key's first value of ``first`` (default
    ``b``), so that a map with ``S0 = x0`` keeps the first value as is.
    """

    name: str
    a: Column
    b: Column
    lo: Column = field(default_factory=lambda: F.lit(-INF))
    hi: Column = field(default_factory=lambda: F.lit(INF))
    init: float | str = 0.0
    first: Column | None = None


def _cols(c: str) -> dict:
    return {k: f"_{k}_{c}" for k in ("a", "b", "lo", "hi", "f")}


def _prepare(df: DataFrame, keys, order, channels, keep, time_col):
    sel = [F.col(k) for k in keys]
    names = list(keys)
    for o in order:
        if o not in names:
            sel.append(F.col(o))
            names.append(o)
    if time_col is not None and time_col not in names:
        sel.append(F.col(time_col))
        names.append(time_col)
    for k in keep:
        if k not in names:
            sel.append(F.col(k))
            names.append(k)
    for ch in channels:
        cn = _cols(ch.name)
        sel += [ch.a.cast("double").alias(cn["a"]), ch.b.cast("double").alias(cn["b"]),
                ch.lo.cast("double").alias(cn["lo"]), ch.hi.cast("double").alias(cn["hi"]),
                (ch.first if ch.first is not None else ch.b).cast("double").alias(cn["f"])]
    narrow = df.select(*sel)
    cols = [F.col(c) for c in list(keys) + list(order)]
    # without a fixed count AQE may merge adjacent small ranges (still
    # contiguous and sorted); partition ids are read inside the same execution
    spark = df.sparkSession
    if spark.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        parts = narrow.repartitionByRange(*cols)
    else:
        parts = narrow.repartitionByRange(scan_partitions(spark), *cols)
    parts = parts.sortWithinPartitions(*(list(keys) + list(order)))
    return parts, names


def _run_starts(pdf: pd.DataFrame, keys) -> np.ndarray:
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for k in keys:
        v = pdf[k]
        isn = v.isna().to_numpy()
        arr = v.astype(object).to_numpy()
        neq = np.zeros(n, dtype=bool)
        if n > 1:
            same_null = isn[1:] & isn[:-1]
            neq[1:] = (arr[1:] != arr[:-1]) & ~same_null
            neq[1:] |= isn[1:] ^ isn[:-1]
        change |= neq
    return change


def _key_tuple(pdf: pd.DataFrame, keys, i):
    return tuple(None if pd.isna(pdf[k].iat[i]) else pdf[k].iat[i] for k in keys)


def _local_fold(keys, channels, time_col, lam, rows_mode, exclusive):
    """Per-partition fold; yields per-row prefix maps (rows mode) or per-run
    summaries. Runs may span Arrow batches; state is carried across them."""
    chans = [c.name for c in channels]

    def fn(it):
        pid = TaskContext.get().partitionId()
        carry = None           # dict describing the open run at the end of the last batch
        pending = None         # rows-mode batch held back until its last run is known closed
        first_batch = True
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            start = _run_starts(pdf, keys)
            first_key = _key_tuple(pdf, keys, 0)
            cont = carry is not None and carry["key"] == first_key
            # segment 0 is the partition's first run if this is the first batch,
            # or if it continues the first run (edge runs: first and last)
            seg0_first = first_batch or (cont and carry["first"])
            first_batch = False
            if pending is not None:
                pdf_prev = pending
                pdf_prev.iloc[-1, pdf_prev.columns.get_loc("_last")] = not cont
                yield pdf_prev
                pending = None
            elif carry is not None and not rows_mode and not cont:
                yield carry["summary"]()
            if cont:
                start[0] = False
            seg = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            # row rank inside the run (continues across batches)
            rk = np.arange(n) - seg
            if cont:
                rk[seg == 0] += carry["rk"] + 1
            # time handling
            if time_col is not None:
                t = pdf[time_col].to_numpy(dtype=np.float64)
                tprev = np.empty(n)
                tprev[1:] = t[:-1]
                tprev[0] = carry["t"] if cont else t[0]
                dt = np.where(start, 0.0, t - tprev)
                if cont:
                    dt[0] = t[0] - carry["t"]
                decay = np.exp(-lam * dt) if lam else np.ones(n)
                t0 = t[seg]
                if cont:
                    t0[seg == 0] = carry["t0"]
            maps = {}
            for c in chans:
                cn = _cols(c)
                a = pdf[cn["a"]].to_numpy(dtype=np.float64)
                if time_col is not None and lam:
                    a = a * decay
                m = (a, pdf[cn["b"]].to_numpy(dtype=np.float64),
                     pdf[cn["lo"]].to_numpy(dtype=np.float64), pdf[cn["hi"]].to_numpy(dtype=np.float64))
                if exclusive:
                    ex = [np.empty(n) for _ in range(4)]
                    ident = (1.0, 0.0, -INF, INF)
                pre = cm.segmented_scan_np(m, seg)
                if cont:
                    sel = seg == 0
                    prev = carry["maps"][c]
                    head = cm.compose_np(tuple(x[sel] for x in pre), tuple(np.full(sel.sum(), v) for v in prev))
                    pre = tuple(x.copy() for x in pre)
                    for k in range(4):
                        pre[k][sel] = head[k]
                if exclusive:
                    for k in range(4):
                        ex[k][1:] = pre[k][:-1]
                        ex[k][start] = ident[k]
                        if cont:
                            ex[k][0] = carry["maps"][c][k]
                    maps[c] = (pre, ex)
                else:
                    maps[c] = (pre, None)
                # first value of the run (for init="first")
                x0 = pdf[cn["f"]].to_numpy(dtype=np.float64)[seg]
                if cont:
                    x0[seg == 0] = carry["x0"][c]
                maps[c] = maps[c] + (x0,)
            last_i = n - 1
            edge = np.zeros(n, dtype=bool)
            if seg0_first:
                edge[seg == 0] = True
            new_carry = {
                "first": bool(edge[last_i]),
                "key": _key_tuple(pdf, keys, last_i),
                "rk": int(rk[last_i]),
                "maps": {c: tuple(float(x[last_i]) for x in maps[c][0]) for c in chans},
                "x0": {c: float(maps[c][2][last_i]) for c in chans},
            }
            if time_col is not None:
                new_carry["t"] = float(t[last_i])
                new_carry["t0"] = float(t0[last_i])
            if rows_mode:
                out = pdf.copy()
                out["_pid"] = np.int32(pid)
                out["_rk"] = rk.astype(np.int64)
                if time_col is not None:
                    out["_t0"] = t0
                for c in chans:
                    pre, ex, x0 = maps[c]
                    for nm, arr in zip(("pa", "pb", "plo", "phi"), pre):
                        out[f"_{nm}_{c}"] = arr
                    if exclusive:
                        for nm, arr in zip(("ea", "eb", "elo", "ehi"), ex):
                            out[f"_{nm}_{c}"] = arr
                    out[f"_x0_{c}"] = x0
                lastflag = np.zeros(n, dtype=bool)
                lastflag[:-1] = start[1:]
                out["_edge"] = edge
                out["_last"] = lastflag
                drop = [v for c in chans for v in _cols(c).values()]
                pending = out.drop(columns=drop)
            else:
                # summaries of the runs closed inside this batch
                ends = np.flatnonzero(np.append(start[1:], False))
                if len(ends):
                    rows = {k: [pdf[k].iat[i] for i in ends] for k in keys}
                    rows["_pid"] = np.full(len(ends), pid, dtype=np.int32)
                    rows["_edge"] = edge[ends]
                    rows["_n"] = (rk[ends] + 1).astype(np.int64)
                    if time_col is not None:
                        rows["_t0"] = t0[ends]
                        rows["_tl"] = t[ends]
                    for c in chans:
                        pre, _, x0 = maps[c]
                        for nm, arr in zip(("pa", "pb", "plo", "phi"), pre):
                            rows[f"_{nm}_{c}"] = arr[ends]
                        rows[f"_x0_{c}"] = x0[ends]
                    yield pd.DataFrame(rows)

                def summary(nc=new_carry, pdf_last=pdf.iloc[[last_i]]):
                    rows = {k: [pdf_last[k].iat[0]] for k in keys}
                    rows["_pid"] = np.array([pid], dtype=np.int32)
                    rows["_edge"] = np.array([True])   # the partition's last run
                    rows["_n"] = np.array([nc["rk"] + 1], dtype=np.int64)
                    if time_col is not None:
                        rows["_t0"] = [nc["t0"]]
                        rows["_tl"] = [nc["t"]]
                    for c in chans:
                        for nm, v in zip(("pa", "pb", "plo", "phi"), nc["maps"][c]):
                            rows[f"_{nm}_{c}"] = [v]
                        rows[f"_x0_{c}"] = [nc["x0"][c]]
                    return pd.DataFrame(rows)
                new_carry["summary"] = summary
            carry = new_carry
        if pending is not None:
            pending.iloc[-1, pending.columns.get_loc("_last")] = True
            pending.iloc[-1, pending.columns.get_loc("_edge")] = True   # the partition's last run
            yield pending
        elif carry is not None and not rows_mode:
            yield carry["summary"]()

    return fn


def _run_schema(df_schema: T.StructType, keys, channels, time_col):
    fields = [df_schema[k] for k in keys]
    fields += [T.StructField("_pid", T.IntegerType()), T.StructField("_edge", T.BooleanType()),
               T.StructField("_n", T.LongType())]
    if time_col is not None:
        fields += [T.StructField("_t0", T.DoubleType()), T.StructField("_tl", T.DoubleType())]
    for c in channels:
        for nm in ("pa", "pb", "plo", "phi", "x0"):
            fields.append(T.StructField(f"_{nm}_{c.name}", T.DoubleType()))
    return T.StructType(fields)


def _fold_runs(keys, channels, lam, time_col, mode):
    """Per key: fold its runs in partition order. ``mode='total'`` gives one
    row per key with the final state; ``mode='carry'`` one row per run with
    the state entering it."""
    chans = [(c.name, c.init) for c in channels]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pid", kind="stable").reset_index(drop=True)
        m = len(pdf)
        acc = None
        out_rows = []
        for j in range(m):
            r = pdf.iloc[j]
            maps = {}
            for c, _ in chans:
                maps[c] = [float(r[f"_pa_{c}"]), float(r[f"_pb_{c}"]), float(r[f"_plo_{c}"]), float(r[f"_phi_{c}"])]
            if mode == "carry":
                if acc is None:
                    out_rows.append((False, float("nan"), {c: float("nan") for c, _ in chans}))
                else:
                    st = {}
                    for c, init in chans:
                        s0 = acc["x0"][c] if init == "first" else float(init)
                        st[c] = float(cm.apply_np(tuple(np.float64(v) for v in acc["maps"][c]), np.float64(s0)))
                    out_rows.append((True, acc["tl"], st))
            if acc is None:
                acc = {"maps": maps, "x0": {c: float(r[f"_x0_{c}"]) for c, _ in chans},
                       "n": int(r["_n"]), "tl": float(r["_tl"]) if time_col else None,
                       "t0": float(r["_t0"]) if time_col else None}
            else:
                g_decay = 1.0
                if time_col is not None and lam:
                    g_decay = math.exp(-lam * (float(r["_t0"]) - acc["tl"]))
                for c, _ in chans:
                    g = maps[c]
                    g = (np.float64(g[0] * g_decay), np.float64(g[1]), np.float64(g[2]), np.float64(g[3]))
                    f = tuple(np.float64(v) for v in acc["maps"][c])
                    acc["maps"][c] = [float(v) for v in cm.compose_np(g, f)]
                acc["n"] += int(r["_n"])
                if time_col is not None:
                    acc["tl"] = float(r["_tl"])
        if mode == "carry":
            res = {k: pdf[k].to_list() for k in keys}
            res["_pid"] = pdf["_pid"].astype(np.int32).to_numpy()
            res["_has_prev"] = [x[0] for x in out_rows]
            res["_t_prev"] = [x[1] for x in out_rows]
            for c, _ in chans:
                res[f"_s_prev_{c}"] = [x[2][c] for x in out_rows]
            return pd.DataFrame(res)
        res = {k: [pdf[k].iat[0]] for k in keys}
        res["n"] = [acc["n"]]
        if time_col is not None:
            res["t_first"] = [acc["t0"]]
            res["t_last"] = [acc["tl"]]
        for c, init in chans:
            s0 = acc["x0"][c] if init == "first" else float(init)
            res[c] = [float(cm.apply_np(tuple(np.float64(v) for v in acc["maps"][c]), np.float64(s0)))]
        return pd.DataFrame(res)

    return fn


def _finish_complete(runs: DataFrame, keys, channels, time_col) -> DataFrame:
    """Final state of keys that lie inside one partition: apply the run's
    composed map to the initial state (JVM expression, no shuffle)."""
    cols = [F.col(k) for k in keys] + [F.col("_n").alias("n")]
    if time_col is not None:
        cols += [F.col("_t0").alias("t_first"), F.col("_tl").alias("t_last")]
    for c in channels:
        cn = c.name
        s0 = F.col(f"_x0_{cn}") if c.init == "first" else F.lit(float(c.init))
        pre = (F.col(f"_pa_{cn}"), F.col(f"_pb_{cn}"), F.col(f"_plo_{cn}"), F.col(f"_phi_{cn}"))
        cols.append(cm.apply_col(pre, s0).alias(cn))
    return runs.select(*cols)


def ordered_fold(df: DataFrame, keys, order, channels, *, time_col=None, lam=0.0) -> DataFrame:
    """Final state per key after folding its rows in ``order``.

    Returns ``keys..., n, [t_first, t_last,] <channel>...``. With ``time_col``
    and ``lam`` every map's ``a`` is multiplied by ``exp(-lam * dt)``, ``dt``
    the time since the key's previous row (0 for its first row).
    """
    checkpoint_dir(df.sparkSession)
    parts, _ = _prepare(df, keys, order, channels, [], time_col)
    run_schema = _run_schema(parts.schema, keys, channels, time_col)
    runs = parts.mapInPandas(_local_fold(keys, channels, time_col, lam, False, False), run_schema)
    # one row per (key, partition): read twice below, so materialised once
    runs = runs.checkpoint()
    out_fields = [parts.schema[k] for k in keys] + [T.StructField("n", T.LongType())]
    if time_col is not None:
        out_fields += [T.StructField("t_first", T.DoubleType()), T.StructField("t_last", T.DoubleType())]
    out_fields += [T.StructField(c.name, T.DoubleType()) for c in channels]
    complete = _finish_complete(runs.filter(~F.col("_edge")), keys, channels, time_col)
    edge = runs.filter(F.col("_edge")).groupBy(*keys).applyInPandas(
        _fold_runs(keys, channels, lam, time_col, "total"), T.StructType(out_fields))
    return complete.unionByName(edge)


def ordered_scan(df: DataFrame, keys, order, channels, *, keep=(), time_col=None, lam=0.0,
                 exclusive=False) -> DataFrame:
    """Per row: the state of each channel after folding the key's rows up to
    and including this row. ``exclusive=True`` adds ``<channel>_prev`` (state
    before the row; null for the key's first row) - not with a time decay.

    Returns ``keys, order, keep, time_col`` columns plus one column per channel.
    """
    if exclusive and lam:
        raise ValueError("exclusive scans do not take a time decay")
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts, names = _prepare(df, keys, order, channels, list(keep), time_col)
    base = parts.schema
    fields = list(base.fields) + [T.StructField("_pid", T.IntegerType()), T.StructField("_rk", T.LongType())]
    if time_col is not None:
        fields.append(T.StructField("_t0", T.DoubleType()))
    for c in channels:
        fields += [T.StructField(f"_{nm}_{c.name}", T.DoubleType()) for nm in ("pa", "pb", "plo", "phi")]
        if exclusive:
            fields += [T.StructField(f"_{nm}_{c.name}", T.DoubleType()) for nm in ("ea", "eb", "elo", "ehi")]
        fields.append(T.StructField(f"_x0_{c.name}", T.DoubleType()))
    fields += [T.StructField("_edge", T.BooleanType()), T.StructField("_last", T.BooleanType())]
    drop = {v for c in channels for v in _cols(c.name).values()}
    schema = T.StructType([f for f in fields if f.name not in drop])
    local = parts.mapInPandas(_local_fold(keys, channels, time_col, lam, True, exclusive), schema)
    local = local.checkpoint(eager=True)

    # only edge runs (a partition's first and last) can continue across partitions
    runs = local.filter(F.col("_last") & F.col("_edge")).select(
        *keys, "_pid", (F.col("_rk") + 1).alias("_n"),
        *([F.col("_t0"), F.col(time_col).cast("double").alias("_tl")] if time_col is not None else []),
        *[F.col(f"_{nm}_{c.name}") for c in channels for nm in ("pa", "pb", "plo", "phi", "x0")])
    carry_fields = [base[k] for k in keys] + [
        T.StructField("_pid", T.IntegerType()), T.StructField("_has_prev", T.BooleanType()),
        T.StructField("_t_prev", T.DoubleType())] + [
        T.StructField(f"_s_prev_{c.name}", T.DoubleType()) for c in channels]
    carry = runs.groupBy(*keys).applyInPandas(_fold_runs(keys, channels, lam, time_col, "carry"),
                                              T.StructType(carry_fields))
    # at most two rows per partition: the broadcast is bounded by the partition count
    carry = F.broadcast(carry)
    cond = [local[k].eqNullSafe(carry[k]) for k in keys] + [local["_pid"] == carry["_pid"]]
    j = local.join(carry, cond, "left")

    out = [local[c] for c in names]
    for c in channels:
        cn = c.name
        s0 = F.col(f"_x0_{cn}") if c.init == "first" else F.lit(float(c.init))
        s_prev = F.col(f"_s_prev_{cn}")
        if time_col is not None and lam:
            s_prev = s_prev * F.exp(F.lit(-lam) * (F.col("_t0") - F.col("_t_prev")))
        s_in = F.when(F.col("_has_prev"), s_prev).otherwise(s0)
        pre = (F.col(f"_pa_{cn}"), F.col(f"_pb_{cn}"), F.col(f"_plo_{cn}"), F.col(f"_phi_{cn}"))
        out.append(cm.apply_col(pre, s_in).alias(cn))
        if exclusive:
            ex = (F.col(f"_ea_{cn}"), F.col(f"_eb_{cn}"), F.col(f"_elo_{cn}"), F.col(f"_ehi_{cn}"))
            has = (F.col("_rk") > 0) | F.coalesce(F.col("_has_prev"), F.lit(False))
            out.append(F.when(has, cm.apply_col(ex, s_in)).alias(f"{cn}_prev"))
    return j.select(*out)
