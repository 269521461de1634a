"""Near-duplicate vectors by a pivot-permutation index.

Pivots are ``2 * sqrt(n)`` vectors drawn by hash, of which those go that lie within
a cosine of 0.75 of an earlier one: a dense family, whatever its share of the rows,
keeps one or a few pivots that all its members name, and isn't described by chance
among many. A vector is described by its nearest pivots, ``length`` of them or more:
the description grows until of sampled links (a link of each of 512 sampled vectors,
if it has one, and a made-up neighbour at a cosine of exactly ``least`` in a random
direction) 0.97 share enough pivots. Each pivot has an inverted list of the vectors
that name it; two vectors are candidates if they share at least ``shared`` pivots,
and candidates are verified by their cosine. With the pivots in one order, vectors
that share ``t`` of ``l`` meet in the list of one of their first ``l - t + 1``, so only
those lists hold a vector; a pair counts in the list of its first common pivot.
Where the square of the description's length exceeds the number of pivots, the lists
would cost as much as all pairs: then all vectors are in one list, and every pair is
compared.

Equal vectors form a class and are compared once. A list is cut into blocks of
bounded size, and two blocks at a time are compared inside a task, which returns
link counts and the components it saw, never the pairs: a long list costs time in
proportion to its pairs, spread over up to 36 tasks, and no rows.

Rows: one per input row. Vectors that are null, zero, or hold null or non-finite
components, or have another length than most, link with nothing (``n_links`` 0,
``component_id = vec_id``). A null ``vec_id`` links with nothing and has a null
component and ``kept`` false. Rows that repeat a ``vec_id`` count as vectors of
their own. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.llm import common as C
from relflow.llm import vectors as V


SAMPLE = 512        # vectors whose links set the length of the descriptions
RECALL = 0.97       # share of the sampled links that the index must find


def _separate(pivots: np.ndarray, most: float) -> np.ndarray:
    """The pivots, in order, without those within a cosine of ``most`` of one kept before."""
    kept = pivots[:0]
    for s in range(0, len(pivots), 256):
        part = pivots[s:s + 256]
        part = part[(part @ kept.T < most).all(axis=1)]
        sims, take = part @ part.T, []
        for i in range(len(part)):
            if (sims[i, take] < most).all():
                take.append(i)
        kept = np.concatenate([kept, part[take]])
    return kept


def _partners(batches, sample: np.ndarray, keys: np.ndarray, least: float):
    """For each sampled vector the first of a task's linked vectors, in an order by hash."""
    import pyarrow as pa
    for batch in batches:
        sims = sample @ V.unit(V.matrix(batch.column("vec"))).T
        ids = batch.column("class_id").to_numpy()
        order = C.mix(ids.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)) >> C.U64(1)
        linked = (sims >= least) & (ids[None, :] != keys[:, None])
        first = np.where(linked, order[None, :], C.U64(1 << 63)).argmin(axis=1) if len(ids) else np.zeros(len(sample), np.int64)
        s = np.flatnonzero(linked.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(order[first[s]].astype(np.int64)), batch.column("vec").take(pa.array(first[s]))],
                                         ["s", "h", "vec"])


def _neighbours(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """A made-up neighbour of each row at exactly ``cosine`` (rows of one number: itself)."""
    if x.shape[1] < 2:
        return x
    u = np.random.default_rng(seed).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * V.unit(u)


def _nearest(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first."""
    sims = x @ pivots.T
    if 4 * length < len(pivots):
        some = np.sort(np.argpartition(-sims, length, axis=1)[:, :length], axis=1)
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :length]


def _found(a: np.ndarray, b: np.ndarray, shared: int) -> float:
    """The share of links, given as their ends' descriptions, that the index finds."""
    return float(((a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1) >= shared).mean()) if len(a) else 1.0


def fitting_length(pivots: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], length: int, shared: int) -> int:
    """The shortest description, of ``length`` pivots or more, that finds enough of each
    set of ``links``; 0 if all pairs cost no more."""
    most = math.isqrt(len(pivots))
    ends = [(_nearest(x, pivots, most), _nearest(y, pivots, most)) for x, y in links]
    for near in range(length, most + 1):
        if all(_found(a[:, :near], b[:, :near], shared) >= RECALL for a, b in ends):
            return near
    return 0


def _describe(batches, pivots: np.ndarray, length: int):
    """Each vector's nearest pivots, as their numbers in ascending order."""
    import pyarrow as pa
    for batch in batches:
        near = np.sort(_nearest(V.unit(V.matrix(batch.column("vec"))), pivots, length), axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("class_id"), batch.column("copies"), batch.column("vec"),
             C.list_array(near.ravel(), np.full(len(near), near.shape[1]), pa.int32())],
            ["class_id", "copies", "vec", "near"])


def _roots(adj: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Components of a block pair: the smallest node number of each row and column."""
    n, m = adj.shape
    big = n + m
    r, c = np.arange(n), (np.arange(m) if same else n + np.arange(m))
    while True:
        r2 = np.minimum(r, np.where(adj, c[None, :], big).min(axis=1, initial=big))
        c2 = r2 if same else np.minimum(c, np.where(adj, r2[:, None], big).min(axis=0, initial=big))
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def _compare(frames, least: float, shared: int):
    """Links between two blocks of a list: counts per class, and edges that
    connect what the links connect."""
    for pdf in frames:
        out = []
        for b in pdf.itertuples(index=False):
            ia, ib = np.asarray(b.ids), np.asarray(b.ids2)
            pa_, pb = np.asarray(b.near).reshape(len(ia), -1), np.asarray(b.near2).reshape(len(ib), -1)
            x = V.unit(np.asarray(b.vecs, np.float64).reshape(len(ia), -1))
            y = V.unit(np.asarray(b.vecs2, np.float64).reshape(len(ib), -1))
            adj = np.zeros((len(ia), len(ib)), bool)
            for s in range(0, len(ia), 256):
                i, j = np.nonzero(x[s:s + 256] @ y.T >= least)
                p, q = pa_[s + i], pb[j]
                count, first = np.zeros(len(i), np.int32), np.full(len(i), -1, np.int32)
                for c in range(p.shape[1] - 1, -1, -1):
                    eq = (p[:, c, None] == q).any(axis=1)
                    count += eq
                    first = np.where(eq, p[:, c], first)
                ok = (count >= shared) & (first == b.pivot)
                adj[s + i[ok], j[ok]] = True
            if b.same:
                np.fill_diagonal(adj, False)
            ca, cb = np.asarray(b.copies, np.int64), np.asarray(b.copies2, np.int64)
            r, c = _roots(adj, b.same)
            names = np.concatenate([ia, ib])
            out.append(pd.DataFrame({"class_id": ia, "n": adj @ cb, "root": names[r]}))
            if not b.same:
                out.append(pd.DataFrame({"class_id": ib, "n": adj.T @ ca, "root": names[c]}))
        rows = pd.concat(out) if out else pd.DataFrame({"class_id": [], "n": [], "root": []}, dtype=np.int64)
        yield rows[rows["n"] > 0]


def near_vectors(table: DataFrame, least: float = 0.9, length: int = 6, shared: int = 2, block: int = 1024, seed: int = 5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``table``
    (vec_id, embedding): links are pairs with a cosine of at least ``least``."""
    rows = C.stored(V.valid_vectors(table))
    classes = C.stored(V.classes(rows).select("k1", "k2", "class_id", "copies", "vec"))
    n = classes.count()
    m = max(length, 2 * math.isqrt(n))
    picked = classes.orderBy(F.xxhash64(F.lit(seed), "k1", "k2"), "class_id").limit(m + SAMPLE).select("class_id", "vec").collect()
    drawn = V.unit(np.array([r["vec"] for r in picked], np.float64)) if picked else np.zeros((0, 0))
    pivots = _separate(drawn[:m], 0.75)
    # sampled vectors: those after the pivots, as far as there are any
    sample, keys = drawn[-SAMPLE:], np.array([r["class_id"] for r in picked[-SAMPLE:]], np.int64)
    near = 0
    if length * length <= len(pivots):
        kind = classes.schema["vec"].dataType.simpleString()
        rows = (classes.select("class_id", "vec").mapInArrow(lambda it: _partners(it, sample, keys, least), f"s long, h long, vec {kind}")
                .groupBy("s").agg(F.min_by("vec", "h").alias("vec")).collect())
        linked = V.unit(np.array([r["vec"] for r in rows], np.float64)) if rows else sample[:0]
        near = fitting_length(pivots, [(sample[[r["s"] for r in rows]], linked), (sample, _neighbours(sample, least, seed))], length, shared)
    if not near:        # one list of all
        pivots, near = pivots[:1], min(1, len(pivots))
    shared = min(shared, near)
    kind = classes.schema["vec"].dataType.simpleString()
    described = classes.select("class_id", "copies", "vec").mapInArrow(
        lambda it: _describe(it, pivots, near), f"class_id long, copies long, vec {kind}, near array<int>")
    # the first ``near - shared + 1`` lists of each vector, in blocks
    listed = C.stored(described.withColumn("pivot", F.explode(F.slice("near", 1, max(1, near - shared + 1)))))
    sizes = listed.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(9), "class_id"), "parts")
    packed = C.stored(listed.join(sizes, "pivot").withColumn("part", part).groupBy("pivot", "part", "parts")
                      .agg(F.collect_list(F.struct("class_id", "copies", "near", "vec")).alias("r"))
                      .select("pivot", "part", "parts", F.col("r.class_id").alias("ids"), F.col("r.copies").alias("copies"),
                              F.flatten("r.near").alias("near"), F.flatten("r.vec").alias("vecs")))
    names = ("ids", "copies", "near", "vecs")
    one = packed.where("parts = 1").select("pivot", *names, *[F.col(c).alias(c + "2") for c in names], F.lit(True).alias("same"))
    # the pairs of blocks of a long list are dealt to cells of two groups of blocks
    many = packed.where("parts > 1").withColumn("groups", F.least(F.lit(8), F.floor(F.col("parts") / 8) + 1).cast("long"))
    group = F.col("part") % F.col("groups")
    other = many.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), group)).alias("g"), group.alias("g2"),
                        F.col("part").alias("part2"), *[F.col(c).alias(c + "2") for c in names])
    many = (many.withColumn("g", group).withColumn("g2", F.explode(F.sequence(group, F.col("groups") - 1))).join(other, ["pivot", "g", "g2"])
            .where("g < g2 OR part <= part2").select("pivot", *names, *[c + "2" for c in names], (F.col("part") == F.col("part2")).alias("same")))
    links = C.stored(one.unionByName(many).mapInPandas(lambda it: _compare(it, least, shared), "class_id long, n long, root long"))
    found = C.components(links, "class_id", "root")
    counts = links.groupBy("class_id").agg(F.sum("n").alias("n"))
    per_class = (classes.select("k1", "k2", "class_id", "copies").join(counts, "class_id", "left").join(found, F.col("class_id") == F.col("node"), "left")
                 .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component")))
    named = F.col("vec_id").isNotNull()
    out = (table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).select("vec_id", *V.keys())
           .withColumn("named", named).join(per_class.withColumn("named", F.lit(True)), ["k1", "k2", "named"], "left"))
    component = F.when(F.col("named"), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
