"""Dense vector expressions on ``array<double>`` columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    """Sum of elementwise products, summed in index order."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x + y)


def scale(v: Column, c: Column) -> Column:
    return F.transform(v, lambda x: x * c)


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))
