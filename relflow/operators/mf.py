"""Online matrix factorisation over a rating table (F11), batch form.

Stratified SGD (DSGD, Gemulla et al., KDD 2011): ratings are blocked by
``(pmod(user, d), pmod(item, d))``. In sub-epoch ``s`` the ``d`` blocks
``(b, (b + s) mod d)`` share no user and no item, so they are trained in
parallel; after ``d`` sub-epochs every rating was seen once per epoch.

Inside a block the reference's per-rating online update runs in rating order
(``e = r - u.v``; ``u += lr*e*v``; ``v += lr*e*u``, both from the vectors
before this rating), in waves: a rating's wave is one after the last wave of its
user and its item, and a wave, in which no user and no item occurs twice, is one
vectorised update (``levels``). A block is streamed: its factor rows are sorted
ahead of its rating rows in one partition, so only the block's vectors - never its
ratings - are held in memory. Factor tables are checkpointed after every
sub-epoch, so each sub-epoch's lineage is cut. The ratings are written once,
in a folder for each stratum, and a sub-epoch reads its own only.

The number of blocks decides the order of the updates, so it comes from the data
(or the caller) and never from the machine: the model is the same everywhere.
"""

from __future__ import annotations

import uuid
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.operators import factors as FX
from relflow.session import checkpoint_dir


# Users and items in a block: a task holds their vectors.
BLOCK_IDS = 250_000


def levels(users: np.ndarray, items: np.ndarray):
    """The ratings of a sequence, as arrays of places: each array holds the ratings
    whose user and item stand in no earlier rating outside the arrays before it. No
    user and no item occurs twice in an array, so its ratings can be applied at once;
    array after array this is the same as one rating after another."""
    n = len(users)
    after, waits = [], np.zeros(n, np.int8)
    for ids in (users, items):
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        following = np.full(n, -1)
        following[order[:-1][same]] = order[1:][same]
        waits[order[1:][same]] += 1
        after.append(following)
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        yield ready
        freed = np.concatenate([f[ready] for f in after])
        freed = freed[freed >= 0]
        np.subtract.at(waits, freed, 1)
        ready = np.unique(freed[waits[freed] == 0])


class _Block:
    """Vectors of one block, and its ratings in order."""

    def __init__(self):
        self.ids, self.rows, self.vectors = {"user": [], "item": []}, {"user": [], "item": []}, None

    def add(self, side: str, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids[side].append(ids)
        self.rows[side].append(vectors)

    def ready(self) -> None:
        self.vectors, self.sorted = {}, {}
        for side in ("user", "item"):
            if self.ids[side]:
                ids = np.concatenate(self.ids[side])
                order = np.argsort(ids, kind="stable")
                self.sorted[side], self.vectors[side] = ids[order], np.concatenate(self.rows[side])[order]
        self.ids = self.rows = None

    def train(self, users: np.ndarray, items: np.ndarray, ratings: np.ndarray, lr: float) -> None:
        if self.vectors is None:
            self.ready()
        at_u, at_v = np.searchsorted(self.sorted["user"], users), np.searchsorted(self.sorted["item"], items)
        u_all, v_all = self.vectors["user"], self.vectors["item"]
        for wave in levels(at_u, at_v):
            iu, iv = at_u[wave], at_v[wave]
            u, v = u_all[iu], v_all[iv]
            step = (lr * (ratings[wave] - np.einsum("ij,ij->i", u, v)))[:, None]
            u_all[iu], v_all[iv] = u + step * v, v + step * u
        if np.isnan(u_all[at_u]).any() or np.isnan(v_all[at_v]).any():
            raise ValueError("factor is not a number")

    def result(self):
        if self.vectors is None:
            self.ready()
        for side, vectors in self.vectors.items():
            for a in range(0, len(vectors), 8192):
                part = vectors[a:a + 8192]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(part)), pa.array(self.sorted[side][a:a + 8192]), lists],
                                                 names=["side", "id", "factors"])


def _block_fn(lr: float, k: int):
    """Rows of a partition, by block: first its vectors (kind 0), then its ratings in
    order (kind 1). Ratings are applied in waves within each Arrow batch."""
    def fn(batches):
        now, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("blk").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                number, kind = divmod(int(key[a]), 2)
                if number != now:
                    if block is not None:
                        yield from block.result()
                    now, block = number, _Block()
                part = batch.slice(a, b - a)
                if kind == 1:
                    block.train(*(part.column(c).to_numpy() for c in ("user_id", "item_id", "rating")), lr)
                else:
                    side, ids = part.column("side").to_numpy(zero_copy_only=False), part.column("id").to_numpy()
                    vectors = part.column("factors").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), k)
                    for s in ("user", "item"):
                        block.add(s, ids[side == s], vectors[side == s])
        if block is not None:
            yield from block.result()

    return fn


def train_mf(ratings: DataFrame, k: int = 10, lr: float = 0.01,
             init_user: Callable[[Column], Column] | None = None,
             init_item: Callable[[Column], Column] | None = None,
             epochs: int = 1, strata: int | None = None, users: DataFrame | None = None,
             items: DataFrame | None = None, order=("ts",), user_col: str = "user_id",
             item_col: str = "item_id", rating_col: str = "rating") -> tuple[DataFrame, DataFrame]:
    """Factorise ``ratings`` (F11). Defaults as the reference main: 10 factors,
    learning rate 0.01, initial values in [-0.01, 0.01) from
    ``java.util.Random(id)``. ``strata`` is the number of blocks trained in
    parallel (default: one for every ``BLOCK_IDS`` users and items, 4 at
    least). Returns ``(users, items)`` factor tables."""
    spark = ratings.sparkSession
    checkpoint_dir(spark)
    init_user = init_user or FX.ranged_init(k, -0.01, 0.01)
    init_item = init_item or FX.ranged_init(k, -0.01, 0.01)
    r = ratings.select(F.col(user_col).cast("long").alias("user_id"), F.col(item_col).cast("long").alias("item_id"),
                       F.col(rating_col).cast("double").alias("rating"), *[F.col(o) for o in order])
    if strata is None:
        n = r.agg(F.approx_count_distinct("user_id", 0.01) + F.approx_count_distinct("item_id", 0.01)).first()[0]
        strata = max(4, -(-n // BLOCK_IDS))
    d = int(strata)
    r = r.withColumn("ub", F.pmod(F.col("user_id"), F.lit(d))).withColumn("ib", F.pmod(F.col("item_id"), F.lit(d)))
    r = r.withColumn("stratum", F.pmod(F.col("ib") - F.col("ub"), F.lit(d)))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ratings-{uuid.uuid4().hex}"
    r.write.partitionBy("stratum").parquet(folder)
    r = spark.read.schema(r.schema).parquet(folder)
    # a key for each block that Spark's hash sends to a partition of its own
    found = {x["p"]: x["id"] for x in spark.range(64 * d + 64).select("id", F.pmod(F.hash("id"), F.lit(d)).alias("p"))
             .groupBy("p").agg(F.min("id").alias("id")).collect()}
    own = F.array(*[F.lit(found.get(b, -1 - b)).cast("long") for b in range(d)])
    u0 = FX.pull_or_init(r, users.withColumnRenamed(user_col, "user_id") if users is not None else
                         spark.createDataFrame([], "user_id long, factors array<double>"), "user_id", init_user)
    i0 = FX.pull_or_init(r, items.withColumnRenamed(item_col, "item_id") if items is not None else
                         spark.createDataFrame([], "item_id long, factors array<double>"), "item_id", init_item)
    model = u0.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "factors").unionByName(
        i0.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "factors")).checkpoint()
    out_schema = T.StructType([T.StructField("side", T.StringType()), T.StructField("id", T.LongType()),
                               T.StructField("factors", T.ArrayType(T.DoubleType()))])
    fn = _block_fn(lr, k)
    for _ in range(epochs):
        for s in range(d):
            # block of a user / an item in this sub-epoch: its user block
            rs = r.filter(F.col("stratum") == s) \
                  .select(F.lit(1).alias("kind"), F.col("ub").alias("blk"), F.lit(None).cast("string").alias("side"),
                          F.lit(None).cast("long").alias("id"),
                          F.lit(None).cast("array<double>").alias("factors"),
                          "user_id", "item_id", "rating", *[F.col(o) for o in order])
            blk = F.when(F.col("side") == "user", F.pmod(F.col("id"), F.lit(d))) \
                   .otherwise(F.pmod(F.pmod(F.col("id"), F.lit(d)) - F.lit(s), F.lit(d)))
            ms = model.select(F.lit(0).alias("kind"), blk.alias("blk"), "side", "id", "factors",
                              F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("item_id"),
                              F.lit(None).cast("double").alias("rating"),
                              *[F.lit(None).cast(rs.schema[o].dataType).alias(o) for o in order])
            both = ms.unionByName(rs).withColumn("own", F.element_at(own, F.col("blk").cast("int") + 1)) \
                     .repartition(d, "own").drop("own") \
                     .sortWithinPartitions("blk", "kind", *order, "user_id", "item_id")
            both = both.drop(*[o for o in order if o not in ("user_id", "item_id", "rating")])
            model = both.mapInArrow(fn, out_schema).checkpoint()
    users_out = model.filter(F.col("side") == "user").select(F.col("id").alias(user_col), "factors")
    items_out = model.filter(F.col("side") == "item").select(F.col("id").alias(item_col), "factors")
    return users_out, items_out


def squared_error(ratings: DataFrame, users: DataFrame, items: DataFrame, user_col: str = "user_id",
                  item_col: str = "item_id", rating_col: str = "rating") -> float:
    """Mean squared error of the model on ``ratings`` (training check)."""
    s = FX.score_pairs(ratings.select(user_col, item_col, rating_col), users, items, user_col, item_col)
    return s.agg(F.avg((F.col(rating_col) - F.col("score")) ** 2)).first()[0]
