"""Vector tables: valid rows, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, vec)`` of the rows of ``table`` (vec_id, embedding) that take
    part: an id, no null or non-finite component, not zero, and of the most
    common length (of equally common ones the largest)."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), v.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & some)
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vec") == (size[0]["d"] if size else 0)).select("vec_id", F.col("embedding").alias("vec"))


def keys(vec: str = "vec") -> list[Column]:
    return [F.xxhash64(F.lit(i), vec).alias(f"k{i}") for i in (1, 2)]


def classes(rows: DataFrame, copies: int = 1) -> DataFrame:
    """Equal vectors as one row: ``(k1, k2, class_id, copies, ids, vec)`` with the
    ``copies`` smallest ids. Salted, so that a vector with a third of all rows
    spreads over tasks."""
    rows = rows.select("vec_id", "vec", *keys()).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    if copies > 1:
        rank = F.row_number().over(Window.partitionBy("k1", "k2", "salt").orderBy("vec_id"))
        few = rows.select("k1", "k2", "salt", "vec_id").withColumn("rank", rank).where(F.col("rank") <= copies)
        ids = few.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, copies).alias("ids"))  # 64 * copies at most
    part = rows.groupBy("k1", "k2", "salt").agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    out = part.groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.sum("n").alias("copies"), F.min_by("vec", "vec_id").alias("vec"))
    if copies > 1:
        return out.join(ids, ["k1", "k2"])
    return out.withColumn("ids", F.array("class_id"))


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, x)`` of the rows of ``table`` (vec_id, embedding, label) whose
    vector has no null or non-finite component and the most common length (of equally
    common ones the largest); ``x`` = floor(``scale`` * component) as longs, within a
    long's range. Zero vectors and null ids stay."""
    v = F.col("embedding").cast("array<double>")
    label = F.col("label") if "label" in table.columns else F.lit(None).cast("int")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & ~bad)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("v") == (size[0]["d"] if size else 0))
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))


def longs(column: pa.Array) -> np.ndarray:
    """A list column of longs without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; very large and small ones are scaled twice."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: str, b: str) -> Column:
    """Cosine of two list columns in double precision, summed in order."""
    def dot(x: str, y: str) -> Column:
        products = F.zip_with(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"), lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
