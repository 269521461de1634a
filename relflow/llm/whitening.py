"""Embedding whitening by Chebyshev-filtered subspace iteration.

Components become integers ``floor(256 * x)``. The fit list is each distinct integer
vector once, stored; ``V`` is its covariance. ``V`` is never formed: one pass of the fit
list, stored as packed blocks of vectors, gives ``V Q`` for a narrow block ``Q``, each
task adding up ``Xc' (Xc Q)`` of its centred rows, so ``d x block`` numbers per task are
shuffled and as many reach the driver.

A filter step applies a polynomial of ``V`` to the block by the three-term Chebyshev
recurrence, a pass a degree. The polynomial stays small on [0, b], b the block's lowest
Ritz value, and grows fast above it: the unwanted spectrum is damped. Then QR and
Rayleigh-Ritz (one more pass) give eigenvalue estimates and residuals. The iteration is
certified when the wanted residuals ``|Vq - eq|`` are at rounding level and a fresh
random block, held orthogonal to the wanted vectors and filtered in the same way, holds
no Ritz value above them. A block that stops getting better is doubled; a block as wide
as the vectors is exact at once.

``fit`` returns means, components and eigenvalues, ``whiten`` applies them to any rows.

Rows: null vectors and vectors with a null or non-finite component are dropped, also
those that have not the most common length (of equally common ones the largest). Zero
vectors, repeated ids and null ids stay, with rows for each input row. Floors beyond
the range of a long are set to its limit. Components whose eigenvalue is below
``ZERO`` (1e-11) of the largest count as absent: rank-deficient vectors and tables with
fewer than five distinct vectors have fewer than four, equal vectors and an empty table
none, so no rows. ``deviation`` is null beyond the range of a long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.llm import common as C
from relflow.llm import vectors as V

SCALE = 256
WANTED = 4
GUARD = 28              # further columns of the block
DEGREE = 12             # of a filter step
TIGHT = 1e-13           # residual, relative to the largest eigenvalue
LOOSE = 1e-10           # no result is returned above it
ZERO = 1e-11            # eigenvalues below this share of the largest count as none
_BLOCK = 1 << 19        # bytes of a stored block of vectors
_LIMIT = float(1 << 62)


@dataclass
class Whitening:
    n: int                      # rows of the fit list
    sums: list[int]             # of its dimensions
    mean: np.ndarray
    values: np.ndarray          # eigenvalues, falling
    vectors: np.ndarray         # d x components
    trace: float
    residual: float             # largest, relative to the largest eigenvalue
    passes: int                 # of the fit list

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """The vectors ``x`` of ``rows`` as binary blocks of at most ``_BLOCK`` bytes or one vector."""
    step = max(1, _BLOCK // (8 * d))

    def run(batches):
        for batch in batches:
            x = V.longs(batch.column(0)).astype("<i8")
            for a in range(0, len(x), step):
                yield pa.RecordBatch.from_pydict({"block": [x[a:a + step].tobytes()]}, schema=pa.schema([("block", pa.binary())]))
    return rows.select("x").mapInArrow(run, "block binary")


def _blocks(batches, d: int):
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and each dimension's sum, as integers of any size."""
    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _blocks(batches, d):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(d, dtype=np.int32), "n": np.full(d, n), "high": high, "low": low})
    parts = fit.mapInArrow(run, "dim int, n long, high long, low long")
    big = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    rows = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), *big).collect())
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


class _Covariance:
    """Products with the covariance of the stored fit list."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray):
        self.fit, self.n, self.mean, self.passes = fit, n, mean, 0

    def summed(self, weights: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over the rows of ``Xc' (Xc W)``, or of ``(Xc W)' (Xc W)``, divided by n."""
        mean, (d, k) = self.mean, weights.shape
        rows = k if gram else d

        def run(batches):
            total = np.zeros((rows, k))
            for x in _blocks(batches, d):
                c = x - mean
                y = c @ weights
                total += (y if gram else c).T @ y
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *map(pa.array, total.T.copy())],
                                                 names=["dim", *(f"c{i}" for i in range(k))])
        self.passes += 1
        parts = self.fit.mapInArrow(run, "dim int, " + ", ".join(f"c{i} double" for i in range(k)))
        out = np.zeros((rows, k))
        for r in parts.groupBy("dim").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).collect():
            out[r[0]] = r[1:]
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        return self.summed(q, False)

    def trace(self) -> float:
        mean = self.mean

        def run(batches):
            yield pa.RecordBatch.from_pydict({"s": [float(sum(((x - mean) ** 2).sum() for x in _blocks(batches, len(mean))))]})
        return self.fit.mapInArrow(run, "s double").agg(F.sum("s")).first()[0] / self.n


def _filtered(v: _Covariance, q: np.ndarray, bound: float, top: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of the covariance applied to ``q``: at most about 1
    on [0, bound], 1 at ``top``'s side of it."""
    half = bound / 2
    if half <= 1e-14 * top:     # nothing left to damp
        return v.times(q)
    sigma = first = half / (top - half)
    y = (v.times(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        q, y = y, (v.times(y) - half * y) * (2 * after / half) - (sigma * after) * q
        sigma = after
    return y


def _ritz(v: _Covariance, q: np.ndarray):
    """Rayleigh-Ritz in the span of ``q``: values (falling), vectors and residuals."""
    q, _ = np.linalg.qr(q)
    q, _ = np.linalg.qr(q)
    vq = v.times(q)
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, np.sqrt(((vq - q * values) ** 2).sum(axis=0))


def _solve(v: _Covariance, d: int, wanted: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues with their vectors, certified."""
    rng = np.random.default_rng(seed)
    width = min(d, wanted + GUARD)
    values, q, res = _ritz(v, rng.normal(size=(d, width)))
    best, stalled = np.inf, 0
    for _ in range(1000):
        top = max(values[0], 0.0)
        worst = res[:wanted].max() / top if top else 0.0
        full = q.shape[1] == d
        if full or worst <= TIGHT or (worst <= LOOSE and stalled >= 2):
            if worst > LOOSE:
                raise RuntimeError(f"eigenvectors not found: residual {worst:.1e}")
            if full or not top:
                return values[:wanted], q[:, :wanted], worst
            # certificate: nothing that the wanted vectors miss lies above them
            kept = q[:, :wanted]
            fresh = rng.normal(size=(d, min(wanted, d - wanted)))
            for _ in range(2):
                fresh -= kept @ (kept.T @ fresh)
            fresh = _filtered(v, fresh, max(values[-1], 0.0), top, DEGREE)
            for _ in range(2):
                fresh -= kept @ (kept.T @ fresh)
            missed = _ritz(v, fresh)
            if missed[0][0] <= values[wanted - 1] + 1e-9 * top:
                return values[:wanted], kept, worst
            q = np.concatenate([q, missed[1]], axis=1)[:, :d]
            values, q, res = _ritz(v, q)
            continue
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if stalled >= 3:        # a cluster wider than the block
            more = min(d, 2 * q.shape[1]) - q.shape[1]
            q, stalled = np.concatenate([q, rng.normal(size=(d, more))], axis=1), 0
        values, q, res = _ritz(v, _filtered(v, q, max(values[-1], 0.0), top, DEGREE))
    raise RuntimeError("eigenvectors not found")


def fit(rows: DataFrame, wanted: int = WANTED, seed: int = 7) -> tuple[Whitening | None, DataFrame | None]:
    """The whitening of the integer vectors ``rows`` (x) and its stored fit list."""
    found = rows.agg(F.max(F.size("x"))).first()[0]
    if not found:
        return None, None
    distinct = C.stored(_packed(rows.select("x").distinct(), found))
    n, sums = _exact_sums(distinct, found)
    mean = np.array([s / n for s in sums])
    v = _Covariance(distinct, n, mean)
    values, vectors, residual = _solve(v, found, min(wanted, found), seed)
    keep = int((values > ZERO * max(values[0], 0.0)).sum())
    if not keep:
        return None, distinct
    return Whitening(n, sums, mean, values[:keep], vectors[:, :keep], v.trace(), residual, v.passes + 1), distinct


def identity_error(model: Whitening, fit_list: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    gram = _Covariance(fit_list, model.n, model.mean).summed(model.weights, True)
    return float(np.abs(gram - np.eye(len(gram))).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n * x - sum)^2``."""
    size = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * n, max(map(abs, sums), default=0)) * 2
    if size * size * max(1, x.shape[1]) < _LIMIT:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    # beyond: in Python integers, still exact
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, component, deviation, whitened)`` of the integer vectors ``rows``
    (vec_id, x), a row for each component."""
    n, sums, mean, weights = model.n, model.sums, model.mean, model.weights
    k = weights.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.longs(batch.column(1))
            y = (x - mean) @ weights
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(at)), pa.array(y.ravel())],
                names=["vec_id", "component", "deviation", "whitened"])
    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation long, whitened double")


def whitened_rows(table: DataFrame) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of
    ``table`` (vec_id, embedding), with the ``eigenvalue`` and the certified ``residual``."""
    rows = C.stored(V.integer_vectors(table, SCALE).select("vec_id", "x"))
    model, fit_list = fit(rows)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                                     "identity_error double, eigenvalue double, residual double")
    error = identity_error(model, fit_list)

    def by_component(values) -> Column:
        return reduce(lambda e, iv: F.when(F.col("component") == iv[0] + 1, F.lit(float(iv[1]))).otherwise(e), enumerate(values), F.lit(None).cast("double"))
    out = whiten(rows, model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      by_component(model.values / model.trace).alias("explained"), F.lit(error).alias("identity_error"),
                      by_component(model.values).alias("eigenvalue"), F.lit(float(model.residual)).alias("residual"))
