"""``java.util.Random(seed).nextDouble()`` sequences as Spark column expressions.

The reference seeds one generator per id and draws the factor vector from it;
replaying the documented 48-bit linear congruential generator gives bit-equal
vectors without a stored table. A vector's states are reached from the seed by
precomputed jumps, for a whole Arrow batch of ids at once (``vectors``): Spark
evaluates the same arithmetic as a ``transform`` element by element without
generated code, which took longer than all other steps of a large query.

The 48-bit product of the column form is made from 24-bit halves so that no step
leaves the 64-bit range (ANSI arithmetic fails on overflow instead of wrapping).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of java.util.Random (public JDK documentation).
MULTIPLIER = 0x5DEECE66D
ADDEND = 0xB
MASK48 = (1 << 48) - 1
_M_HI = MULTIPLIER >> 24
_M_LO = MULTIPLIER & 0xFFFFFF
_LOW24 = 0xFFFFFF
DOUBLE_UNIT = 2.0 ** -53


def scramble(seed: Column) -> Column:
    """Initial state of ``new Random(seed)``."""
    return seed.cast("long").bitwiseXOR(F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK48))


def lcg_next(s: Column) -> Column:
    """``s * MULTIPLIER + ADDEND  mod 2^48`` without leaving 64 bits."""
    hi = F.shiftright(s, 24)
    lo = s.bitwiseAND(F.lit(_LOW24))
    mid = (hi * F.lit(_M_LO) + lo * F.lit(_M_HI)).bitwiseAND(F.lit(_LOW24))
    return (mid * F.lit(1 << 24) + lo * F.lit(_M_LO) + F.lit(ADDEND)).bitwiseAND(F.lit(MASK48))


def _jump_table(n: int) -> list[tuple[int, int]]:
    """``(A_j, C_j)`` with ``state_j = A_j * state_0 + C_j  mod 2^48`` for
    ``j = 1..n`` (composition of the affine LCG step with itself)."""
    out, a, c = [], 1, 0
    for _ in range(n):
        a, c = (a * MULTIPLIER) & MASK48, (c * MULTIPLIER + ADDEND) & MASK48
        out.append((a, c))
    return out


def vectors(seeds: np.ndarray, k: int, lo: float = 0.0, hi: float = 1.0) -> np.ndarray:
    """``lo + (hi - lo) * nextDouble()``, ``k`` times for ``new Random(seed)`` of each
    whole number: one row a seed. Products wrap at 2^64, a multiple of 2^48."""
    jumps = np.array(_jump_table(2 * k), dtype=np.uint64).reshape(k, 2, 2)
    start = ((seeds.astype(np.int64).astype(np.uint64) ^ np.uint64(MULTIPLIER)) & np.uint64(MASK48))[:, None]
    high, low = ((start * jumps[:, i, 0] + jumps[:, i, 1]) & np.uint64(MASK48) for i in (0, 1))
    u = ((high >> np.uint64(22)) * np.uint64(1 << 27) + (low >> np.uint64(21))).astype(np.float64) * DOUBLE_UNIT
    return u if (lo, hi) == (0.0, 1.0) else float(lo) + (float(hi) - float(lo)) * u


def next_doubles(seed: Column, k: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``array(lo + (hi - lo) * nextDouble())`` of length ``k`` for ``new Random(seed)``;
    of a null seed ``k`` nulls."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def draw(ids: pa.Array) -> pa.Array:
        none = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), k) if ids.null_count else None
        values = vectors(ids.fill_null(0).to_numpy(zero_copy_only=False), k, lo, hi)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k, dtype=np.int32)), pa.array(values.ravel(), mask=none))

    return draw(seed.cast("long"))


class Initial:
    """Initial vectors of ids, as a column and for an array of ids."""

    def __init__(self, k: int, lo: float = 0.0, hi: float = 1.0):
        self.k, self.lo, self.hi = k, lo, hi

    def __call__(self, ids: Column) -> Column:
        return next_doubles(ids, self.k, self.lo, self.hi)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return vectors(ids, self.k, self.lo, self.hi)


def java_random_doubles(seed: int, k: int) -> list[float]:
    """Plain-Python replay (tests)."""
    s = (seed ^ MULTIPLIER) & MASK48
    out = []
    for _ in range(k):
        s = (s * MULTIPLIER + ADDEND) & MASK48
        a = s >> 22
        s = (s * MULTIPLIER + ADDEND) & MASK48
        b = s >> 21
        out.append(((a << 27) + b) * DOUBLE_UNIT)
    return out
