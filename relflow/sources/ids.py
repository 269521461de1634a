"""Unique ids for requests (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.operators.meeting import stored


def assign_evaluation_id(df: DataFrame, out: str = "evaluation_id", ordered_by=None) -> DataFrame:
    """Unique increasing Long per row (A4).

    Default: ``monotonically_increasing_id()`` - unique, increasing within a
    partition, no shuffle. ``ordered_by``: dense ids ``0..n-1`` following that
    order (``assign_ordered_ids``).
    """
    if ordered_by:
        return assign_ordered_ids(df, list(ordered_by), out=out)
    return df.withColumn(out, F.monotonically_increasing_id())


def assign_ordered_ids(df: DataFrame, order, out: str = "id") -> DataFrame:
    """Dense ``0..n-1`` ids in ``order`` without a single-task window. The rows are
    range-partitioned, sorted and stored once with their place in their partition; a
    row's id is its place plus the rows of the partitions before, of which there are as
    many as shuffle partitions."""
    order = list(order)
    keep = [c for c in df.columns if c not in set(order)]
    rows = df.select(*order, *keep).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("long")).alias("_before"))
    res = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return res.select(*order, *keep, (F.col("_before") + place).alias(out))
