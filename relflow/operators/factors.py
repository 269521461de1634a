"""Factor vectors: initialisation, scoring, deltas and updates.

Factor tables are DataFrames ``(<id>, factors array<double>)``. Everything is a
column expression or a join. Pairs meet their vectors in cells (``operators.meeting``);
besides, a user-supplied Python initialiser (F4) runs in Python, as an Arrow-batched
pandas UDF.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.functions import jrandom
from relflow.functions import vectors as V
from relflow.operators.meeting import with_vectors


# ----------------------------------------------------------- initialisers

def ranged_init(k: int, lo: float, hi: float) -> Callable[[Column], Column]:
    """``lo + (hi - lo) * nextDouble()`` from ``java.util.Random(id)``."""
    return jrandom.Initial(k, lo, hi)


def seeded_init(k: int) -> Callable[[Column], Column]:
    """``nextDouble()`` from ``java.util.Random(id)``, values in [0, 1)."""
    return jrandom.Initial(k)


def random_init(k: int, seed: int = 0) -> Callable[[Column], Column]:
    """uniform values in [0, 1) drawn from ``md5("seed:id:position")`` (52
    bits): random over ids, the same under every partitioning and rerun."""
    def unit(id_col: Column, i: int) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"), F.lit(str(i))))
        return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    return lambda id_col: F.array(*[unit(id_col, i) for i in range(k)])


def python_init(fn: Callable[[int], "list[float] | np.ndarray"]) -> Callable[[Column], Column]:
    """a user-supplied initialiser ``id -> vector`` as a pandas UDF."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _init(ids: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(fn(int(i)), dtype=np.float64) for i in ids])

    return lambda id_col: _init(id_col)


def init_factors(ids: DataFrame, id_col: str, init: Callable[[Column], Column]) -> DataFrame:
    """Initial vector per id (F1-F4): ``(id, factors)``."""
    return ids.select(F.col(id_col), init(F.col(id_col)).alias("factors"))


# ---------------------------------------------------------------- scoring

def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, user_col: str = "user_id",
                item_col: str = "item_id") -> DataFrame:
    """Dot product of the user and item vectors of each row."""
    j = with_vectors(pairs, users, items, user_col, item_col)
    return j.withColumn("score", V.dot(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def vector_norms(df: DataFrame, col: str = "factors") -> DataFrame:
    """Squared length (the reference's ``length``) and length per vector."""
    sq = V.sq_norm(F.col(col))
    return df.withColumn("sq_norm", sq).withColumn("norm", F.sqrt(sq))


# ---------------------------------------------------------------- updates

def vector_size(df: DataFrame, col: str) -> int:
    """Length of the vectors of a column (all vectors of a table share it)."""
    r = df.select(F.size(col)).filter(F.col(f"size({col})") > 0).first()
    return int(r[0]) if r else 0


def sum_deltas(deltas: DataFrame, keys, col: str = "delta", k: int | None = None) -> DataFrame:
    """Elementwise sum of all delta vectors per key: ``k`` plain ``sum``
    aggregates over the array elements - a code-generated hash aggregation
    with map-side partial sums, so a popular id is reduced before the
    shuffle and never collected."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = k or vector_size(deltas, col)
    s = deltas.groupBy(*keys).agg(*[F.sum(F.col(col)[i]).alias(f"_s{i}") for i in range(k)])
    return s.select(*keys, F.array(*[F.col(f"_s{i}") for i in range(k)]).alias(col))


def _add_checked(base: Column, delta: Column) -> Column:
    return F.when(delta.isNull(), base).otherwise(V.add(base, delta))


def _nan_guard(df: DataFrame, col: str = "factors") -> DataFrame:
    """Fail on a NaN coordinate, as the reference's vector sum does."""
    return df.withColumn(col, F.when(V.has_nan(F.col(col)), F.raise_error(F.lit("factor is not a number")))
                         .otherwise(F.col(col)))


def apply_deltas(factors: DataFrame, deltas: DataFrame, id_col: str,
                 init: Callable[[Column], Column] | None = None, col: str = "delta",
                 k: int | None = None) -> DataFrame:
    """Add the (summed) delta vectors to the vectors of the same id.

    Ids without a vector are initialised with ``init`` (as the reference's
    server does) or, without ``init``, keep no row. Fails on a NaN result, like
    the reference's vector sum. Ids without deltas are returned unchanged.
    """
    d = sum_deltas(deltas, id_col, col, k)
    how = "full_outer" if init is not None else "left"
    j = factors.join(d, id_col, how)
    base = F.col("factors")
    if init is not None:
        base = F.coalesce(base, init(F.col(id_col)))
    new = j.select(F.col(id_col), _add_checked(base, F.col(col)).alias("factors"))
    return _nan_guard(new)


def pull_or_init(ids: DataFrame, factors: DataFrame, id_col: str,
                 init: Callable[[Column], Column]) -> DataFrame:
    """Current vector of each requested id, or its initial vector (F8)."""
    j = ids.select(id_col).distinct().join(factors.select(id_col, "factors"), id_col, "left")
    return j.select(F.col(id_col), F.coalesce(F.col("factors"), init(F.col(id_col))).alias("factors"))


def sgd_updater(lr: float) -> Callable[[Column, Column, Column], tuple[Column, Column]]:
    """F9 default: ``e = r - u.v``; ``du = lr*e*v``, ``dv = lr*e*u`` (no
    regularisation, both from the pre-update vectors). Returns
    ``(step, du, dv)``: ``step`` = ``lr*e`` is computed once per row, the
    deltas refer to it by column."""

    def upd(r: Column, u: Column, v: Column):
        step = F.lit(lr) * (r - V.dot(u, v))
        return step, (lambda c: V.scale(v, c)), (lambda c: V.scale(u, c))

    return upd


def _delta_columns(lr: float, rating_col: str, names: list[str], sides: tuple[str, ...]):
    """The default updater in a cell: the pairs with their deltas, from both vectors. A null
    rating or coordinate gives null coordinates, as in Spark's expressions."""
    def plain(u, v, r):
        whole = r is not None and len(u) == len(v) and None not in u and None not in v
        step = lr * (r - sum(a * b for a, b in zip(u, v))) if whole else None
        return [[x * step if step is not None and x is not None else None for x in w] for w in (v, u)]

    def make(rows, u, v):
        r = rows.column(rating_col).cast(pa.float64())
        k = len(u.flatten()) // max(1, len(u))
        even = all(not w.null_count and not w.flatten().null_count and (w.value_lengths().to_numpy(zero_copy_only=False) == k).all() for w in (u, v))
        if even:
            u, v = (w.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, k) for w in (u, v))
            step = lr * (r.fill_null(0.0).to_numpy() - np.einsum("ij,ij->i", u, v))
            none = np.repeat(r.is_null().to_numpy(zero_copy_only=False), k) if r.null_count else None
            ends = pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)) if k else pa.array(np.zeros(len(u) + 1, np.int32))
            out = {s: pa.ListArray.from_arrays(ends, pa.array((w * step[:, None]).ravel(), mask=none)) for s, w in (("user", v), ("item", u)) if s in sides}
        else:
            both = [plain(*x) if x[0] is not None and x[1] is not None else [None if w is None else [None] * len(w) for w in (x[1], x[0])]
                    for x in zip(u.to_pylist(), v.to_pylist(), r.to_pylist())]
            out = {s: pa.array([b[n] for b in both], pa.list_(pa.float64())) for n, s in enumerate(("user", "item"))}
        return pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *(out[s] for s in sides)],
                                          names=[*names, *({"user": "du", "item": "dv"}[s] for s in sides)])
    return make


def sgd_deltas(ratings: DataFrame, users: DataFrame, items: DataFrame, lr: float = 0.01,
               updater=None, user_col: str = "user_id", item_col: str = "item_id",
               rating_col: str = "rating", sides: tuple[str, ...] = ("user", "item")) -> DataFrame:
    """Per rating: the user and item deltas (F9). ``users``/``items`` must hold
    a vector for every id (see ``pull_or_init``). ``updater(r, u, v) ->
    (step, du_fn, dv_fn)`` is pluggable (Column functions; ``step`` is a
    per-row scalar materialised once, ``du_fn(step)``/``dv_fn(step)`` give
    the delta vectors). The default one works in the cells where pairs meet their vectors,
    so that only deltas leave them. ``sides``: the deltas that are wanted, ``du`` of "user",
    ``dv`` of "item"."""
    upd = updater or sgd_updater(lr)
    options = {}
    names = [item_col, user_col, *(c for c in ratings.columns if c not in (user_col, item_col))]
    if updater is None and isinstance(ratings.schema[rating_col].dataType, (T.IntegralType, T.FloatType, T.DoubleType)) \
            and {f.schema["factors"].dataType.simpleString() for f in (users, items)} == {"array<double>"}:
        vector = T.ArrayType(T.DoubleType())
        options = {"result": _delta_columns(lr, rating_col, names, sides),
                   "columns": T.StructType([T.StructField(n, ratings.schema[n].dataType) for n in names]
                                           + [T.StructField({"user": "du", "item": "dv"}[s], vector) for s in sides])}
    j = with_vectors(ratings, users, items, user_col, item_col, **options)
    if "_u" not in j.columns:
        return j
    step, du_fn, dv_fn = upd(F.col(rating_col).cast("double"), F.col("_u"), F.col("_v"))
    # the scalar goes through its own projection; the optimizer does not
    # inline a non-cheap expression into two higher-order functions
    j = j.withColumn("_step", step)
    j = j.withColumn("du", du_fn(F.col("_step"))).withColumn("dv", dv_fn(F.col("_step")))
    return j.drop("_u", "_v", "_step", *({"user": "du", "item": "dv"}[s] for s in ("user", "item") if s not in sides))
