"""User folds given as Spark expressions (C7): no Python, no whole key in one task.

``Monoid``: an ordered fold cut at will. ``lift`` makes a piece of a row, ``merge`` joins
two neighbouring pieces (it must be associative), ``finish`` reads the result off the
last piece. Rows get a dense number in key and fold order; pieces whose numbers agree
after division by ``fanout`` are merged, level after level, until a key has one piece.
No group holds more than ``fanout`` pieces, so a hot key costs one more level, not a
task of its own size.

``Sequential``: a plain update ``(state, value) -> state``, which can't be cut. A key's
values are packed in order into arrays of at most ``fanout`` values, spread over
tasks; a round folds one array of every key that has that many. Memory stays bounded
by one array, but the rounds follow the hottest key: use a ``Monoid`` where there is one.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.session import checkpoint_dir
from relflow.sources.ids import assign_ordered_ids


@dataclass(frozen=True)
class Monoid:
    lift: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda piece: piece


@dataclass(frozen=True)
class Sequential:
    update: Callable[[Column, Column], Column]


def _numbered(df: DataFrame, value: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Keys, ``_at`` (dense number in key and fold order) and ``_x``."""
    rows = df.select(*keys, *[o for o in order if o not in keys], value.alias("_x"))
    return assign_ordered_ids(rows, [*keys, *[o for o in order if o not in keys]], out="_at").select(*keys, "_at", "_x")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def _in_order(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda s: s["p"])


def monoid_fold(df: DataFrame, value: str, monoid: Monoid, keys, order, fanout: int = 4096) -> DataFrame:
    """``(keys, value, n)``: each key's fold over its rows in ``order``."""
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    rows = _numbered(df, monoid.lift(F.col(value)), keys, list(order))
    kind = rows.schema["_x"].dataType.simpleString()       # parsed anew: every field may be null
    cur = rows.select(*keys, F.col("_at").cast("long").alias("_at"), F.col("_x").alias("p"), F.lit(1).cast("long").alias("_n")).checkpoint()
    top = cur.agg(F.max("_at")).first()[0] or 0

    def level(rows: DataFrame, group: Column) -> DataFrame:
        got = rows.groupBy(*keys, group.alias("_up")).agg(F.collect_list(F.struct(F.col("_at").alias("o"), "p")).alias("items"), F.sum("_n").alias("_n"))
        got = got.withColumn("items", _in_order(F.col("items")))
        rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
        folded = F.aggregate(rest, F.element_at("items", 1).cast(kind), lambda a, b: monoid.merge(a, b).cast(kind))
        return got.select(*keys, F.col("_up").alias("_at"), folded.alias("p"), "_n")
    while True:
        cur = level(cur, F.expr(f"_at div {fanout}"))
        if not top:
            break
        top //= fanout
    return cur.select(*keys, monoid.finish(F.col("p")).alias("value"), F.col("_n").alias("n"))


def sequential_fold(df: DataFrame, value: str, fold: Sequential, keys, order, fanout: int = 65_536) -> DataFrame:
    """``(keys, value, n)``: the first value as is, then ``update(state, value)``."""
    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    rows = _numbered(df, F.col(value).cast("double"), keys, list(order)).checkpoint()
    first = rows.groupBy(*keys).agg(F.min("_at").alias("_first"))
    packs = rows.withColumn("_cut", F.expr(f"_at div {fanout}")).groupBy(*keys, "_cut").agg(
        F.collect_list(F.struct(F.col("_at").alias("o"), F.col("_x").alias("p"))).alias("items"))
    packs = (_joined(packs, first, keys)
             .select(*keys, (F.col("_cut") - F.expr(f"_first div {fanout}")).alias("_round"), _in_order(F.col("items")).alias("items")).checkpoint())
    step = lambda start, items: F.aggregate(items, start, lambda s, x: fold.update(s, x).cast("double"))
    state = packs.where("_round = 0").select(*keys, step(F.element_at("items", 1), F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))).alias("value"),
                                             F.size("items").cast("long").alias("n"))
    for r in range(1, (packs.agg(F.max("_round")).first()[0] or 0) + 1):
        more = packs.where(F.col("_round") == r).select(*keys, "items")
        state = _joined(state, more, keys, "left").select(
            *keys, F.when(F.col("items").isNull(), F.col("value")).otherwise(step(F.col("value"), F.col("items"))).alias("value"),
            (F.col("n") + F.coalesce(F.size("items"), F.lit(0))).alias("n")).checkpoint()
    return state
