"""Nearest neighbours by a forest of random-projection trees.

Each tree halves a sample of the vectors again and again: a node's direction is
the difference of two random vectors of its part, its threshold the median. The
forest is fitted on at most ``fit_rows`` vectors (a documented bound, so its size is
bounded too); every vector of the table is then sent to its leaf in every tree.

The trees are as deep as leaves of about ``leaf_rows`` rows ask for, as far as the
sample has ``least`` vectors for each; beyond that leaves grow with the table.

A query searches all trees through one priority queue: the entry with the least
distance to the planes crossed so far is taken next, a node's near side goes on
at once, its far side enters the queue, and leaves are collected until they hold
enough rows (counted once a tree). How many are enough is measured: ``tuning``
queries, drawn by hash, are compared with every row, and the budget is the least
with which the queue comes to ``recall`` of their true neighbours. Vectors without
structure have no near neighbours to speak of and need most of the table; clustered
vectors need a few leaves.

The candidates are scored in cells of a block of rows and a block of queries. A row
comes to a cell once, with its leaf in every tree, and a query with one bit for each leaf
that it takes; a row is a candidate, scored once, if one of its leaves is taken. Rows and
queries are so shuffled once for each block of the other side, not once for each leaf. Each
cell's best, by the exact cosine of the original vectors and the smaller id, are ranked
again over all cells.

Equal vectors are one candidate and are written out by their smallest ids, so
copies cost nothing. Blocks are dealt by hash: a cell holds about ``part_rows`` rows, and
its queries stream past them.

Rows: ``k`` for each query (fewer if there are fewer candidates), nearest first,
ties to the smaller ``vec_id``. Vectors that are null, zero, hold null or
non-finite components, or have another length than most, and rows without
``vec_id``, take no part. Repeated rows count once. A ``vec_id`` with several
vectors is one query and one candidate, with its best score, and never its own
neighbour. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.llm import common as C
from relflow.llm import vectors as V
from relflow.session import scan_partitions

CELLS, CELL_PAIRS = 64, 1 << 24
QUERIES, TILE = 256, 4096       # queries that meet members at once, and these
NEAR_TIE = 1e-9


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node ``i`` has the children ``2i + 1`` and ``2i + 2``."""
    normals: np.ndarray     # tree x node x dimension
    offsets: np.ndarray     # tree x node; infinite: all go left
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (numbered over the forest) of each vector in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, at]) >= self.offsets[t, at]
                at = 2 * at + 1 + right
            out[:, t] = (t << self.depth) + at - ((1 << self.depth) - 1)
        return out

    def search(self, v: np.ndarray, counts: list[int], want: float, side: np.ndarray | None = None) -> tuple[list[int], float]:
        """Leaves in the order of the shared queue until they hold ``want`` rows, and
        the distance of the last; ``side``: the vector's ``sides``, where they are known."""
        inner, out, have, last = (1 << self.depth) - 1, [], 0, 0.0
        side = (self.normals @ v - self.offsets if side is None else side).tolist()
        queue = [(0.0, t, 0) for t in range(len(side))]
        while queue and have < want:
            far, t, i = heapq.heappop(queue)
            mine = side[t]
            while i < inner:
                m = mine[i]
                near = 2 * i + 2 if m >= 0 else 2 * i + 1
                if m > -np.inf:
                    heapq.heappush(queue, (max(far, abs(m)), t, 4 * i + 3 - near))
                i = near
            leaf = (t << self.depth) + i - inner
            if counts[leaf]:
                out.append(leaf)
                have += counts[leaf]
                last = far
        return out, last

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Signed distances of each vector to each plane: vector x tree x node."""
        flat = self.normals.reshape(-1, self.normals.shape[-1])
        return (x @ flat.T).reshape(len(x), *self.offsets.shape) - self.offsets

    def taken(self, side: np.ndarray, counts: np.ndarray, want: float) -> np.ndarray:
        """Which leaves ``search`` takes, by one vector's ``sides``: all that are nearer
        than the last one, and in the queue's order those at its distance."""
        inner, far = (1 << self.depth) - 1, [np.zeros((len(side), 1))]
        for d in range(self.depth):
            m = side[:, (1 << d) - 1:(2 << d) - 1]
            beyond = np.maximum(far[-1], abs(m))
            both = np.stack([np.where(m >= 0, beyond, far[-1]), np.where(m >= 0, far[-1], beyond)], axis=2)
            far.append(both.reshape(len(side), -1))
        ends = far[-1].ravel()
        held = (counts > 0) & (ends < np.inf)
        places = np.flatnonzero(held)
        places = places[np.argsort(ends[places], kind="stable")]
        upto = np.cumsum(counts[places])
        if not len(places) or upto[-1] < want:
            return held
        last = ends[places[np.searchsorted(upto, want)]]
        out = held & (ends < last)
        have = counts[out].sum()
        queue = []      # nodes that entered the queue at this distance
        for d, now in enumerate(far):
            new = now == last
            if d:
                new &= np.repeat(far[d - 1], 2, axis=1) < last
            t, i = np.nonzero(new)
            queue += zip(t.tolist(), (i + (1 << d) - 1).tolist())
        heapq.heapify(queue)
        while queue and have < want:
            t, i = heapq.heappop(queue)
            while i < inner:
                m = side[t, i]
                near = 2 * i + 2 if m >= 0 else 2 * i + 1
                if abs(m) <= last:
                    heapq.heappush(queue, (t, 4 * i + 3 - near))
                i = near
            leaf = (t << self.depth) + i - inner
            out[leaf] = counts[leaf] > 0
            have += counts[leaf]
        return out

    def nearer(self, v: np.ndarray, limit: float) -> np.ndarray:
        """Which leaves the queue takes before one at the distance ``limit``."""
        side = self.normals @ v - self.offsets
        far = np.zeros((len(side), 1))
        for d in range(self.depth):
            m = side[:, (1 << d) - 1:(2 << d) - 1]
            both = np.stack([np.where(m >= 0, np.maximum(far, abs(m)), far), np.where(m >= 0, far, np.maximum(far, abs(m)))], axis=2)
            far = both.reshape(len(side), -1)
        return (far < limit * (1 - 1e-9)).ravel()


def grow(sample: np.ndarray, trees: int, depth: int, least: int, seed: int) -> Forest:
    n, d = sample.shape if sample.size else (0, 1)
    normals, offsets = np.zeros((trees, (1 << depth) - 1, d)), np.full((trees, (1 << depth) - 1), np.inf)
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        parts = {0: np.arange(n)}
        for i in range((1 << depth) - 1):
            rows = parts.pop(i, np.zeros(0, np.int64))
            left, right = rows, rows[:0]
            if len(rows) >= 2 * least:
                a, b = rng.choice(rows, 2, replace=False)
                way = sample[a] - sample[b]
                size = np.sqrt(way @ way)
                if size > 0:
                    p = sample[rows] @ (way / size)
                    cut = float(np.median(p))
                    if (p < cut).any():
                        normals[t, i], offsets[t, i] = way / size, cut
                        left, right = rows[p < cut], rows[p >= cut]
            parts[2 * i + 1], parts[2 * i + 2] = left, right
    return Forest(normals, offsets, depth)


def _routed(batches, forest: Forest):
    for batch in batches:
        leaves = forest.leaves(V.unit(V.matrix(batch.column("vec"))))
        n, t = leaves.shape
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), C.list_array(leaves.ravel(), np.full(n, t), pa.int64())], ["class_id", "leaves"])


def _visits(batches, forest: Forest, counts: np.ndarray, want: float):
    """Queries with a bit for each leaf that they take; ``spot``: their leaf in the first tree."""
    for batch in batches:
        x = V.unit(V.matrix(batch.column("vec")))
        taken = []
        for s in range(0, len(x), 64):
            taken += [np.packbits(forest.taken(side, counts, want)).tobytes() for side in forest.sides(x[s:s + 64])]
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(taken, pa.binary()), pa.array(forest.leaves(x)[:, 0] if len(x) else [], pa.int64()),
                                          batch.column("vec")], ["query_id", "taken", "spot", "vec"])


def _true_neighbours(batches, asked: np.ndarray, k: int):
    """The ``k`` nearest of each batch to each sampled query, without its own direction."""
    for batch in batches:
        sims = asked @ V.unit(V.matrix(batch.column("vec"))).T
        sims[sims > 1 - 1e-9] = -2
        n = min(k, sims.shape[1])
        best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), n)), batch.column("class_id").take(pa.array(best.ravel())),
                                          pa.array(np.take_along_axis(sims, best, axis=1).ravel())], ["q", "class_id", "near"])


def budget(forest: Forest, counts: list[int], asked: np.ndarray, true: list[tuple[int, list[int]]], recall: float) -> float:
    """The rows, counted once a tree, within which the queue reaches ``recall`` of the
    true neighbours, given as the query's number and the neighbour's leaves."""
    order = [forest.search(v, counts, np.inf)[0] for v in asked]
    upto = np.full((len(asked), len(counts)), np.inf)
    for q, leaves in enumerate(order):
        upto[q, leaves] = np.cumsum(np.asarray(counts)[leaves])
    need = np.sort([upto[q, leaves].min() for q, leaves in true])
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 0.0


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in order as ``vectors.cosine`` does."""
    def dot(x, y):
        return np.cumsum(x * y, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class _Members:
    """The rows of a cell, and the best of them for queries."""

    def __init__(self, ids, raw, leaves, n_leaves: int, k: int):
        self.ids, self.raw, self.leaves, self.n_leaves, self.k = ids, raw, leaves, n_leaves, k
        self.unit = V.unit(raw)

    def candidates(self, taken: list[bytes]) -> np.ndarray:
        """Rows x queries, a bit each: whether one of the row's leaves is taken."""
        of = np.unpackbits(np.frombuffer(b"".join(taken), np.uint8).reshape(len(taken), -1), axis=1, count=self.n_leaves)
        by_leaf = np.packbits(of.T, axis=1)
        met = by_leaf[self.leaves[:, 0]]
        for t in range(1, self.leaves.shape[1]):
            met |= by_leaf[self.leaves[:, t]]
        return met

    def best(self, raw: np.ndarray, taken: list[bytes]):
        """(query's place, row's place, cosine): the ``k`` best candidates of each query,
        ties by the smaller id."""
        x, met = V.unit(raw), self.candidates(taken)
        cols = np.flatnonzero(met.any(axis=1))
        top, found, n = np.full((len(x), self.k), -np.inf), [], 0
        s, step = 0, 512
        while s < len(cols):
            at = cols[s:s + step]
            s, step = s + step, TILE
            mask = np.unpackbits(met[at], axis=1, count=len(x)).T.astype(bool)
            if np.count_nonzero(mask) > 0.1 * mask.size:
                sims = np.where(mask, x @ self.unit[at].T, -np.inf)
            else:
                sims = np.full(mask.shape, -np.inf)
                i, j = np.nonzero(mask)
                sims[i, j] = np.einsum("ij,ij->i", x[i], self.unit[at[j]])
            i, j = np.nonzero(mask & (sims >= top[:, :1] - NEAR_TIE))       # near ties are told apart exactly
            if not len(i):
                continue
            count = np.bincount(i, minlength=len(x))
            wide = np.full((len(x), self.k + count.max()), -np.inf)
            wide[:, :self.k] = top
            wide[i, self.k + np.arange(len(i)) - (np.cumsum(count) - count)[i]] = sims[i, j]
            top = np.partition(wide, count.max(), axis=1)[:, -self.k:]      # the k-th in front
            found.append((i, at[j], sims[i, j]))
            n += len(i)
            if n > 16 * TILE:
                found = [self._exact(found, top, raw)]
                n = len(found[0][0])
        return self._exact(found, top, raw) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _exact(self, found, top, raw):
        i, j, s = (np.concatenate(f) for f in zip(*found))
        stay = s >= top[i, 0] - NEAR_TIE
        i, j, s = i[stay], j[stay], s[stay]
        exact = np.concatenate([_cosines(raw[i[a:a + TILE]], self.raw[j[a:a + TILE]]) for a in range(0, len(i), TILE)]) if len(i) else np.zeros(0)
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        return i[few], j[few], exact[few]


def _cell_hits(batches, n_leaves: int, k: int):
    """Rows of a partition, by cell: its members, then its queries; the ``k`` best members of
    the cell for each query."""
    cell, held, members = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, is_query = batch.column("cell").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (is_query[1:] != is_query[:-1])) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:]):
            if cell != cells[a]:
                cell, held, members = cells[a], [], None
            part = batch.slice(a, b - a)
            if not is_query[a]:
                held.append((part.column("who").to_numpy(), V.matrix(part.column("vec")), V.longs(part.column("leaves")).astype(np.int32)))
                continue
            if members is None and held:
                members, held = _Members(*(np.concatenate(h) for h in zip(*held)), n_leaves, k), []
            if members is None:
                continue
            who, raw, taken = part.column("who").to_numpy(), V.matrix(part.column("vec")), part.column("taken").to_pylist()
            for s in range(0, len(who), QUERIES):
                i, j, near = members.best(raw[s:s + QUERIES], taken[s:s + QUERIES])
                yield pa.RecordBatch.from_arrays([pa.array(who[s + i]), pa.array(members.ids[j]), pa.array(near)], ["query_id", "class_id", "near"])


def cell_counts(rows: int, queries: int, row_bytes: int, query_bytes: int, block_rows: int) -> tuple[int, int]:
    """Blocks of rows and of queries: about ``CELLS`` cells, fewer if they had less than
    ``CELL_PAIRS`` pairs, of the ways to cut so many the one that copies the fewest bytes."""
    cells = max(1, min(CELLS, -(-rows * queries // CELL_PAIRS)))
    rb = math.ceil(math.sqrt(cells * rows * row_bytes / max(1, queries * query_bytes)))
    rb = max(1, -(-rows // block_rows), min(rb, cells))
    return rb, max(1, min(-(-cells // rb), queries))


def nearest(table: DataFrame, queries: Column, k: int = 5, trees: int = 12, leaf_rows: int = 128, recall: float = 0.95,
            tuning: int = 128, fit_rows: int = 65_536, least: int = 16, part_rows: int = 65_536, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``table`` (vec_id,
    embedding) found nearest by cosine to each row that fulfils ``queries``, a
    condition on ``vec_id``. ``recall`` 1: all leaves are searched."""
    spark = table.sparkSession
    rows = C.stored(V.valid_vectors(table))
    # the k nearest may all be copies, and one more id may be the query's own
    classes = C.stored(V.classes(rows.distinct(), copies=k + 1).select("class_id", "ids", "vec"))
    n = classes.count()
    picked = classes.orderBy(F.xxhash64(F.lit(seed), "class_id"), "class_id").limit(fit_rows).select("vec").toPandas()["vec"]
    sample = V.unit(np.array([np.asarray(v, np.float64) for v in picked])) if len(picked) else np.zeros((0, 0))
    depth = max(1, min(math.ceil(math.log2(max(2, n) / leaf_rows)), int(math.log2(fit_rows / least))))
    forest = grow(sample, trees, depth, least, seed)
    shipped = spark.sparkContext.broadcast(forest)      # trees * 2^depth planes, at most trees * fit_rows / least

    kind = classes.schema["vec"].dataType.simpleString()
    leaves = C.stored(classes.select("class_id", "vec").mapInArrow(lambda it: _routed(it, shipped.value), "class_id long, leaves array<long>"))
    counts = [0] * (trees << depth)
    for r in leaves.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():      # one row a leaf
        counts[r["leaf"]] = r["count"]
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    want = np.inf
    if recall < 1:
        drawn = asked.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(tuning).select("vec").collect()
        drawn = V.unit(np.array([r["vec"] for r in drawn], np.float64)) if drawn else np.zeros((0, 0))
        true = []
        if len(drawn):
            best = Window.partitionBy("q").orderBy(F.desc("near"), "class_id")
            true = (classes.select("class_id", "vec").mapInArrow(lambda it: _true_neighbours(it, drawn, k), "q long, class_id long, near double")
                    .where("near > -2").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
                    .join(leaves, "class_id").select("q", "leaves").collect())      # k rows for each of ``tuning`` queries
        want = max(budget(forest, counts, drawn, [(r["q"], r["leaves"]) for r in true], recall), 16.0 * k)
    number = np.asarray(counts, np.int64)
    visits = C.stored(asked.select("query_id", "vec").repartition(scan_partitions(spark), "query_id").mapInArrow(
        lambda it: _visits(it, shipped.value, number, want), "query_id long, taken binary, spot long, vec " + kind))
    size = 4 * len(sample[0]) if len(sample) else 4
    rb, qb = cell_counts(n, visits.count(), size + 8 * trees, size + len(counts) // 8, part_rows)

    def block(col: str, parts: int):
        return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(parts))

    def copies(parts: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    members = (leaves.join(classes.select("class_id", "vec"), "class_id").withColumn("_q", copies(qb))
               .select((block("class_id", rb) * qb + F.col("_q")).cast("int").alias("cell"), F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("spot"),
                       F.col("class_id").alias("who"), "leaves", F.lit(b"").alias("taken"), "vec"))
    asking = (visits.withColumn("_r", copies(rb))
              .select((F.col("_r") * qb + block("query_id", qb)).cast("int").alias("cell"), F.lit(True).alias("is_query"), "spot",
                      F.col("query_id").alias("who"), F.array().cast("array<long>").alias("leaves"), "taken", "vec"))
    both = members.unionByName(asking).repartitionById(rb * qb, "cell").sortWithinPartitions("cell", "is_query", "spot")
    n_leaves = len(counts)
    hits = both.mapInArrow(lambda it: _cell_hits(it, n_leaves, k + 1), "query_id long, class_id long, near double")
    hits = hits.groupBy("query_id", "class_id").agg(F.max("near").alias("near"))
    few = Window.partitionBy("query_id").orderBy(F.desc("near"), "class_id")
    hits = C.stored(hits.withColumn("r", F.row_number().over(few)).where(F.col("r") <= 2 * (k + 1)).select("query_id", "class_id"))

    exact = (hits.join(classes, "class_id").join(asked.withColumnRenamed("vec", "query"), "query_id")
             .withColumn("score", V.cosine("query", "vec")).select("query_id", "score", F.explode("ids").alias("vec_id"))
             .where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
