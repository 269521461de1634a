"""Event rows -> signed / counted pair interactions (projections and filters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.fixtures import EVENT_ORDER
from relflow.plans.ordered_scan import INF, Channel, ordered_scan

A1 = "actor1Code_countryCode"
A2 = "actor2Code_countryCode"

# Fixed values of the reference: quad class -> relation weight.
DEFAULT_TRANSLATE = {1: 0.01, 2: 0.02, 3: -0.01, 4: -0.02}
# Fixed value of the reference: initial "last seen day", 2017-03-28T22:00Z in ms.
DEFAULT_LAST_DAY_MS = 1490738400000
MS_PER_DAY = 86400000


def with_both_actors(df: DataFrame, a: str = A1, b: str = A2) -> DataFrame:
    """Keep events where both actor country codes are set (B1)."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def canonical_pair(df: DataFrame, a: str = A1, b: str = A2) -> DataFrame:
    """Unordered pair (B2): the greater code becomes ``actor1``, the lesser
    ``actor2``; equal codes stay a self pair. Apply after ``with_both_actors``
    (``greatest``/``least`` skip nulls)."""
    return df.withColumn("actor1", F.greatest(F.col(a), F.col(b))) \
             .withColumn("actor2", F.least(F.col(a), F.col(b)))


def _translate_expr(quad: Column, translate: dict) -> Column:
    expr = None
    for k, v in sorted(translate.items()):
        expr = (F.when(quad == F.lit(k), F.lit(float(v))) if expr is None
                else expr.when(quad == F.lit(k), F.lit(float(v))))
    return expr


def known_quad(quad_col: str = "quadClass", translate: dict | None = None) -> Column:
    translate = translate or DEFAULT_TRANSLATE
    return F.col(quad_col).isin(*translate.keys()) & F.col(quad_col).isNotNull()


def quad_score(df: DataFrame, translate: dict | None = None, quad_col: str = "quadClass",
               norm: float | None = None, on_unknown: str = "drop", out: str = "score") -> DataFrame:
    """Relation weight of the quad class (B3), optionally divided by ``norm``
    (B4). Unknown or null classes: ``"drop"`` (default; see
    ``unknown_quad_rows``), ``"error"`` (fails the query) or ``"null"``."""
    translate = translate or DEFAULT_TRANSLATE
    score = _translate_expr(F.col(quad_col), translate)
    if norm is not None:
        score = score / F.lit(float(norm))
    if on_unknown == "drop":
        return df.filter(known_quad(quad_col, translate)).withColumn(out, score)
    if on_unknown == "error":
        return df.withColumn(out, F.when(known_quad(quad_col, translate), score).otherwise(
            F.raise_error(F.concat(F.lit("unknown quad class: "), F.coalesce(F.col(quad_col).cast("string"), F.lit("null"))))))
    if on_unknown == "null":
        return df.withColumn(out, score)
    raise ValueError(f"on_unknown: {on_unknown}")


def unknown_quad_rows(df: DataFrame, translate: dict | None = None, quad_col: str = "quadClass") -> DataFrame:
    """The rows ``quad_score(on_unknown='drop')`` leaves out."""
    return df.filter(~F.coalesce(known_quad(quad_col, translate), F.lit(False)))


def day_ms(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_date(c).cast("long") * F.lit(MS_PER_DAY)


def event_time_locf(df: DataFrame, day_col: str = "day", partition_cols=("source",),
                    order_cols=EVENT_ORDER, default: int = DEFAULT_LAST_DAY_MS, out: str = "ts",
                    keep=None) -> DataFrame:
    """Event time = the day in ms; a null day reuses the last non-null day seen
    before it in the same partition (B5), ``default`` before any.

    Partition and order are the caller's (the reference uses the task a row
    happens to land in). Runs as a skew-safe ordered scan: one partition value
    may hold all rows and still spreads over every task. The scan materialises
    its rows, so ``keep`` (default: all columns) should name only the columns
    needed downstream.
    """
    keep = [c for c in (keep if keep is not None else df.columns)
            if c not in set(partition_cols) | set(order_cols)]
    x = day_ms(day_col).cast("double")
    ch = Channel("_locf", a=F.when(x.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
                 b=F.coalesce(x, F.lit(0.0)), lo=F.lit(-INF), hi=F.lit(INF), init=float(default))
    res = ordered_scan(df, list(partition_cols), list(order_cols), [ch], keep=keep)
    return res.withColumn(out, F.col("_locf").cast("long")).drop("_locf")


def event_time_or(df: DataFrame, col: str = "dateAdded", default: int = -1, out: str = "ts") -> DataFrame:
    """Event time from ``dateAdded`` in ms, ``default`` (-1) when null."""
    return df.withColumn(out, F.coalesce(day_ms(col), F.lit(default).cast("long")))


def signed_interactions(events: DataFrame, translate: dict | None = None,
                        partition_cols=("source",), order_cols=EVENT_ORDER) -> DataFrame:
    """B1 -> B5 -> B2 -> B3: ``actor1, actor2, quadClass, ts, score`` + order columns,
    the input of the relation-score operators."""
    ev = with_both_actors(events)
    if "source" in partition_cols and "source" not in ev.columns:
        ev = ev.withColumn("source", F.lit("events"))
    # only what the relation operators read goes through the scan
    ev = event_time_locf(ev, partition_cols=partition_cols, order_cols=order_cols,
                         keep=[A1, A2, "quadClass", "day"])
    ev = canonical_pair(ev)
    return quad_score(ev, translate)
