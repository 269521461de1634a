"""Keyed pair state in a stream without hot tasks (C11).

Every micro-batch goes through the ordered scan of the batch operators: its rows are
range-partitioned by pair and time, folded in pieces as composed clamp maps and
carried over the pieces' edges, so a pair that holds a third of a micro-batch spreads
over many tasks and is never held whole. A pair's state enters as its first row: the
fold of ``S -> clamp(S * decay) + x`` from nothing gives ``x``, so a row with the stored
value and the stored time puts the fold where the last micro-batch left it.

The state is a ``LatestStateTable`` (shared folder, versions by batch id). A micro-batch
is handed to ``sink`` before its state is committed: after a failure in between it comes
again with the same rows and the same id, so a sink that writes a folder of that id is
exact. Late rows follow the policies of ``relation_state``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.fixtures import EVENT_ORDER
from relflow.operators.state import DEFAULT_BOUND, DEFAULT_LAMBDA, PAIR
from relflow.plans.ordered_scan import Channel, ordered_scan
from relflow.sinks.writers import LatestStateTable

# Exponent beyond which a factor for a jump back in time acts like infinity: it takes
# every score but 0 to the bound.
_STEEPEST = 345.0


def score_batch(batch: DataFrame, state: DataFrame | None, lam: float = DEFAULT_LAMBDA, bound: float = DEFAULT_BOUND, late: str = "reference",
                ts_col: str = "ts", score_col: str = "score", order=EVENT_ORDER, keys=PAIR) -> DataFrame:
    """The changes of one micro-batch after ``state`` (keys, raw_score, norm, last_ts):
    keys, time, order columns, ``raw_score, norm, score`` and the pair's new ``last_ts``."""
    if late not in ("reference", "no_decay"):
        raise ValueError(f"late: {late}")
    keys, order = list(keys), [o for o in order if o not in keys]
    rows = batch.select(*keys, F.col(ts_col).alias("_ts"), *order, F.col(score_col).cast("double").alias("_x"))
    new = rows.select("*", F.col("_ts").alias("_t"), F.lit(1.0).alias("_w"), F.lit(1).alias("_new"))
    if state is not None:
        first = rows.groupBy(*keys).agg(F.min("_ts").alias("_first"))
        known = state.select(*keys, "raw_score", "norm", "last_ts").join(first, keys)
        if late == "no_decay":      # time stands still until the rows pass the state's
            new = new.join(known.select(*keys, "last_ts"), keys, "left").withColumn("_t", F.greatest("_ts", F.coalesce("last_ts", "_ts"))).drop("last_ts")
            start = F.col("last_ts")
        else:
            start = F.least("last_ts", F.col("_first") + F.lit(int(_STEEPEST / lam)) if lam > 0 else F.col("last_ts"))
        old = known.select(*keys, F.lit(None).cast(rows.schema["_ts"].dataType).alias("_ts"),
                           *[F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in order],
                           F.col("raw_score").alias("_x"), start.alias("_t"), F.col("norm").alias("_w"), F.lit(0).alias("_new"))
        new = new.unionByName(old)
    x, w, b = F.col("_x"), F.col("_w"), F.lit(bound)
    channels = [Channel("raw_score", a=F.lit(1.0), b=x, lo=x - b, hi=x + b, init=0.0), Channel("norm", a=F.lit(1.0), b=w, lo=w - b, hi=w + b, init=0.0)]
    out = ordered_scan(new, keys, ["_new", "_t", "_ts", *order], channels, keep=["_new", "_ts"], time_col="_t", lam=lam).where("_new = 1")
    return out.select(*keys, F.col("_ts").alias(ts_col), *order, "raw_score", "norm", (F.col("raw_score") / F.col("norm")).alias("score"),
                      F.col("_t").cast("long").alias("last_ts"))


def count_batch(batch: DataFrame, state: DataFrame | None, order=EVENT_ORDER, keys=PAIR) -> DataFrame:
    """Running counts of one micro-batch after ``state`` (keys, n)."""
    keys, order = list(keys), [o for o in order if o not in keys]
    new = batch.select(*keys, *order, F.lit(1.0).alias("_c"), F.lit(1).alias("_new"))
    if state is not None:
        known = state.select(*keys, "n").join(batch.select(*keys).distinct(), keys)
        new = new.unionByName(known.select(*keys, *[F.lit(None).cast(new.schema[o].dataType).alias(o) for o in order],
                                           F.col("n").cast("double").alias("_c"), F.lit(0).alias("_new")))
    out = ordered_scan(new, keys, ["_new", *order], [Channel("n", a=F.lit(1.0), b=F.col("_c"))], keep=["_new"]).where("_new = 1")
    return out.select(*keys, *order, F.col("n").cast("long").alias("n"))


def _started(events: DataFrame, table: LatestStateTable, changes_of, sink, checkpoint: str, trigger: dict | None, hidden=()):
    def run(batch: DataFrame, batch_id: int) -> None:
        done = table.current_batch()
        if done is not None and batch_id <= done:
            return
        changes = changes_of(batch, table.read()).checkpoint()
        sink(changes.drop(*hidden), batch_id)
        table.upsert(changes, batch_id)
    w = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def start_relation_scores(events: DataFrame, state_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None],
                          lam: float = DEFAULT_LAMBDA, bound: float = DEFAULT_BOUND, late: str = "reference", ts_col: str = "ts",
                          score_col: str = "score", order=EVENT_ORDER, keys=PAIR, trigger: dict | None = None):
    """C4 over a stream: ``sink(changes, batch_id)`` gets a row for each event, with
    ``raw_score, norm, score``. Returns ``(query, state table)``."""
    table = LatestStateTable(events.sparkSession, state_path, keys, ("last_ts", ts_col, *[o for o in order if o not in keys]))
    run = lambda batch, state: score_batch(batch, state, lam, bound, late, ts_col, score_col, order, keys)
    return _started(events, table, run, sink, checkpoint, trigger, ("last_ts",)), table


def start_counts(events: DataFrame, state_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], order=EVENT_ORDER,
                 keys=PAIR, trigger: dict | None = None):
    """C1 over a stream: ``sink`` gets each event with its pair's running count ``n``."""
    table = LatestStateTable(events.sparkSession, state_path, keys, ("n",))
    return _started(events, table, lambda batch, state: count_batch(batch, state, order, keys), sink, checkpoint, trigger), table
