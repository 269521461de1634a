"""Clamped affine maps ``S -> min(max(a*S + b, lo), hi)`` and their composition.

Every ordered per-key state the library keeps is a fold of such maps:

* decayed relation score: ``S -> clamp(e^(-lam*dt) * S, -100, 100) + x``
  = ``(a=e^(-lam*dt), b=x, lo=x-100, hi=x+100)``
* count / sum: ``(1, x, -inf, inf)``
* exponential smoothing ``S*w + x*(1-w)``: ``(w, (1-w)*x, -inf, inf)``
* last non-null value: ``(0, x, -inf, inf)`` for a value, identity for null
* running max / min: ``(1, 0, x, inf)`` / ``(1, 0, -inf, x)``

For ``a >= 0`` the composition of two such maps is again one (``g`` after
``f``)::

    a  = ag*af
    b  = ag*bf + bg
    lo = clamp(ag*lo_f + bg, lo_g, hi_g)
    hi = clamp(ag*hi_f + bg, lo_g, hi_g)

so an ordered fold can be cut into pieces, each piece folded on its own, and
the pieces folded in order - the basis of the skew-safe scans in
``relflow.plans.ordered_scan``. ``ag*lo_f`` is taken as 0 when ``ag == 0``
(constant map), which keeps ``0*inf`` out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


# ---------------------------------------------------------------- numpy side

def _scale(a, v):
    return np.where(a == 0.0, 0.0, a * v)


def compose_np(g, f):
    """Compose map tuples ``(a, b, lo, hi)`` elementwise: ``g`` after ``f``."""
    ag, bg, lg, hg = g
    af, bf, lf, hf = f
    with np.errstate(invalid="ignore", over="ignore"):
        a = ag * af
        b = _scale(ag, bf) + bg
        lo = np.minimum(np.maximum(_scale(ag, lf) + bg, lg), hg)
        hi = np.minimum(np.maximum(_scale(ag, hf) + bg, lg), hg)
    return a, b, lo, hi


def apply_np(m, s):
    a, b, lo, hi = m
    with np.errstate(invalid="ignore", over="ignore"):
        return np.minimum(np.maximum(_scale(a, s) + b, lo), hi)


def _grouped_cumsum(b, group):
    import pandas as pd
    return pd.Series(b).groupby(group, sort=False).cumsum().to_numpy(dtype=np.float64)


def segmented_scan_np(maps, seg_start):
    """Inclusive ordered scan of maps within segments.

    ``maps``: tuple of 4 arrays (one map per row, rows in fold order);
    ``seg_start``: int array, index of the first row of each row's segment.
    Returns the prefix maps ``m_i o ... o m_start``.

    Unclamped maps with ``a`` in {0, 1} (counts, sums, last values) take an
    ``O(n)`` path: a running sum restarted at the segment start and at every
    constant map (``a == 0``), summed in row order. Everything else runs the
    ``O(n log n)`` log-step (Hillis-Steele) composition.
    """
    n = len(seg_start)
    a, b, lo, hi = (np.asarray(x, dtype=np.float64) for x in maps)
    if n and np.all(np.isneginf(lo)) and np.all(np.isposinf(hi)) and np.all((a == 0.0) | (a == 1.0)):
        idx = np.arange(n)
        last_reset = np.maximum.accumulate(np.where(a == 0.0, idx, -1))
        reset = last_reset >= seg_start
        base = np.where(reset, last_reset, seg_start)
        pb = _grouped_cumsum(b, base)
        pa = np.where(reset, 0.0, 1.0)
        return pa, pb, np.full(n, -INF), np.full(n, INF)
    cur = tuple(np.asarray(x, dtype=np.float64).copy() for x in maps)
    idx = np.arange(n)
    d = 1
    while d < n:
        src = idx - d
        ok = src >= seg_start
        if not ok.any():
            break
        sel = idx[ok]
        prev = tuple(x[src[ok]] for x in cur)
        mine = tuple(x[sel] for x in cur)
        new = compose_np(mine, prev)
        nxt = tuple(x.copy() for x in cur)
        for k in range(4):
            nxt[k][sel] = new[k]
        cur = nxt
        d *= 2
    return cur


# --------------------------------------------------------------- Column side

def _scale_col(a: Column, v: Column) -> Column:
    return F.when(a == F.lit(0.0), F.lit(0.0)).otherwise(a * v)


def _clamp_col(v: Column, lo: Column, hi: Column) -> Column:
    # NaN-transparent clamp spelled with CASE (Spark's least/greatest treat NaN
    # as the largest value, numpy's minimum/maximum propagate it).
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def compose_col(g: tuple, f: tuple) -> tuple:
    ag, bg, lg, hg = g
    af, bf, lf, hf = f
    return (ag * af,
            _scale_col(ag, bf) + bg,
            _clamp_col(_scale_col(ag, lf) + bg, lg, hg),
            _clamp_col(_scale_col(ag, hf) + bg, lg, hg))


def apply_col(m: tuple, s: Column) -> Column:
    a, b, lo, hi = m
    return _clamp_col(_scale_col(a, s) + b, lo, hi)
