"""Mixing sources to target weights, with exact quotas dealt to shards by a
multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) get the weights in turn and
share the total size of all documents; a source stops at ``cap`` times its own
size, and what lies above is shared again by weight until none is above.

Blocks: a document's words are cut into blocks of ``block_words`` (None: the
whole document is one). A source's blocks are put into one seeded random order.
Its quota of words is full passes over all blocks and a last pass over the first
blocks of that order, the last of them cut so that the words come out exactly.

Shards: the draws of all sources are a multiset of which every shard gets a
random part of equal size. A binary tree over the shards holds at each node how
many draws of each source lie below it; a node's left child gets a
multivariate-hypergeometric sample of these counts, the right child the rest.
Draws are counted in the source's order, so the counts alone say which shard owns
a draw, shards are disjoint, and all of it follows from the seed: a task that is
run again gets the same answer. Within a shard ``order_key`` gives the local
shuffle. The tree is a function of one number for each source and is worked out
in the tasks, which keep at most ``SplitTree.KEPT`` of its numbers and work out the
others again for each batch. Nodes of 10^9 draws and more are split source by source
(up to about 10^12 draws: a split then holds some 10^7 numbers for a moment).

Ranks come from hash bins of bounded size and the bins' totals, so a source that
holds a third of all blocks spreads over tasks. Only one row for each source
reaches the driver.

Rows: each row counts on its own, repeated ones too. Null texts have size 0;
documents without words are never drawn. A null source is a source of its own. An
empty table gives no rows. Other columns are not read; ``mixed_documents`` returns them
all. A row is known by its file and its place there, so the draws find it whatever
tasks a later scan cuts the files into; rows that come from no file are stored first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.llm import common as C

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free.difference_update(over)
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are among the ``good``, for counts of
    any size: the inverse of the distribution, summed up over the values within ten
    standard deviations of its mean (what lies beyond has less weight than rounding)."""
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mean = n * (good / total)
    spread = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    a, b = max(low, int(mean - 10 * spread) - 50), min(high, int(mean + 10 * spread) + 50)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)      # log p(x+1)/p(x)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + min(int(np.searchsorted(p, rng.random() * p[-1], side="right")), b - a)


class SplitTree:
    """Owner of each draw: ``quotas[s]`` draws of source ``s`` over ``shards``."""

    KEPT = 1 << 22          # numbers of the tree that a task keeps (32 MB)
    NUMPY_LIMIT = 10**9     # numpy's sampler takes fewer draws than this

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed, self.nodes = np.array(quotas, np.int64), shards, seed, {}

    def _left(self, a: int, b: int, have: np.ndarray) -> np.ndarray:
        """Draws of each source that the left half of shards a..b-1 gets."""
        if (a, b) in self.nodes:
            return self.nodes[a, b]
        rng = np.random.Generator(np.random.PCG64([self.seed, a, b]))
        total = int(have.sum())
        n = total * ((a + b) // 2 - a) // (b - a)
        if total < self.NUMPY_LIMIT:
            left = rng.multivariate_hypergeometric(have, n, method="marginals")
        else:
            left = np.zeros(len(have), np.int64)
            for s, good in enumerate(have.tolist()):
                total -= good
                left[s] = hypergeometric(rng, good, total, n)
                n -= int(left[s])
        if (len(self.nodes) + 1) * len(have) <= self.KEPT:
            self.nodes[a, b] = left
        return left

    def owners(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The shard of each (source, number of the draw in the source's order)."""
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.shards, self.quotas, np.arange(len(source)), draw)]
        while todo:
            a, b, have, rows, at = todo.pop()
            if not len(rows):
                continue
            if b - a == 1:
                out[rows] = a
                continue
            left, mid = self._left(a, b, have), (a + b) // 2
            mine = left[source[rows]]
            is_left = at < mine
            todo.append((a, mid, left, rows[is_left], at[is_left]))
            todo.append((mid, b, have - left, rows[~is_left], (at - mine)[~is_left]))
        return out


@dataclass
class Mix:
    docs: DataFrame         # the documents as a table of files
    sizes: DataFrame        # row, file, place, doc_id, source, size
    sources: DataFrame      # source, source_no, source_size, target, passes, cut_bin, cut_hash, bins
    draws: DataFrame        # row, doc_id, block, start_word, words, source_no, draw, shard, order_key


def _hash(seed: int, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", block.cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3, block_words: int | None = 256,
        shard_draws: int = 100_000, bin_blocks: int = 4096, seed: int = 17) -> Mix:
    """The mix of ``docs`` (doc_id, text, source): which blocks, how often, and
    in which shard of about ``shard_draws`` draws."""
    spark = docs.sparkSession
    docs = C.in_files(docs)
    sizes = C.stored(docs.select(F.monotonically_increasing_id().alias("row"), *C.place(docs), F.col("doc_id").cast("long").alias("doc_id"),
                                 F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    n_blocks = F.ceil(F.col("size") / block_words) if block_words else F.least(F.col("size"), F.lit(1))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.sum(n_blocks).alias("blocks")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    target = targets([r["size"] for r in rows], weight, cap)
    quota = [round(t) for t in target]
    passes = [q // r["size"] if r["size"] else 0 for q, r in zip(quota, rows)]
    rest = [q - p * r["size"] for q, p, r in zip(quota, passes, rows)]
    bins = [max(1, -(-int(r["blocks"]) // bin_blocks)) for r in rows]
    kind = "source string, source_no int, source_size long, target double, passes long, rest long, blocks long, bins long"
    table = spark.createDataFrame([(r["source"], i, r["size"], target[i], passes[i], rest[i], int(r["blocks"]), bins[i])
                                   for i, r in enumerate(rows)], kind)

    # every block with its rank, and the words before it, in its source's random order
    src = C.small(table, len(rows)).withColumnRenamed("source", "source_key")
    blocks = (sizes.where("size > 0").join(src, F.col("source").eqNullSafe(F.col("source_key")))
              .select("row", "doc_id", "size", "source_no", "passes", "rest", "blocks", "bins",
                      F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)).alias("block")))
    first = F.col("block") * block_words if block_words else F.lit(0)
    blocks = (blocks.withColumn("start_word", first.cast("long"))
              .withColumn("words", F.least(F.col("size") - F.col("start_word"), F.lit(block_words or 1 << 62)))
              .withColumn("h", _hash(seed, F.col("block"))).withColumn("bin", F.pmod("h", "bins")))
    whole = blocks.groupBy("source_no", "bin").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    upto = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("source_no", "bin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("source_no", "bin").orderBy("h", "doc_id", "size", "block", "row")
    ranked = (blocks.withColumn("rank", F.row_number().over(inside) - 1)
              .withColumn("cum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
              .join(whole, ["source_no", "bin"])
              .withColumn("rank", F.col("rank") + F.col("n0")).withColumn("cum", F.col("cum") + F.col("w0")))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("cum")))
    ranked = C.stored(ranked.select("row", "doc_id", "source_no", "passes", "blocks", "block", "start_word", "words",
                                    "bin", "h", "rank", last.alias("last")))
    cuts = {r["source_no"]: r for r in ranked.groupBy("source_no").agg(
        F.sum((F.col("last") > 0).cast("long")).alias("n"),
        F.max(F.when(F.col("last") > 0, F.struct("bin", "h"))).alias("cut")).collect()}
    of = [cuts.get(i) for i in range(len(rows))]
    quotas = [passes[i] * int(r["blocks"]) + (of[i]["n"] if of[i] else 0) for i, r in enumerate(rows)]
    ends = [tuple(c["cut"]) if c and c["cut"] else (None, None) for c in of]
    table = spark.createDataFrame([(r["source"], i, r["size"], target[i], passes[i], bins[i], *ends[i]) for i, r in enumerate(rows)],
                                  "source string, source_no int, source_size long, target double, passes long, bins long, cut_bin long, cut_hash long")
    table = C.small(table, len(rows))

    # the draws: one row for each pass that takes the block
    times = F.col("passes") + (F.col("last") > 0).cast("long")
    draws = (ranked.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), times)))
             .select("row", "doc_id", "block", "start_word",
                     F.when(F.col("pass") > F.col("passes"), F.col("last")).otherwise(F.col("words")).alias("words"),
                     "source_no", ((F.col("pass") - 1) * F.col("blocks") + F.col("rank")).alias("draw")))
    shards = max(1, -(-sum(quotas) // shard_draws))

    def place(frames):
        tree = SplitTree(quotas, shards, seed)
        for pdf in frames:
            pdf["shard"] = tree.owners(pdf["source_no"].to_numpy(), pdf["draw"].to_numpy())
            yield pdf

    draws = draws.mapInPandas(place, "row long, doc_id long, block long, start_word long, words long, source_no int, draw long, shard long")
    return Mix(docs, sizes, table, draws.withColumn("order_key", F.xxhash64(F.lit(seed), "shard", "source_no", "draw")))


def taken(m: Mix) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, draws, first_shard,
    last_shard)``: the words that the shards take of each document, repeats counted, in
    how many draws, and the least and the greatest of these shards (null: never drawn)."""
    got = m.draws.groupBy("row").agg(F.sum("words").alias("taken"), F.count("shard").alias("draws"),
                                     F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    src = m.sources.select(F.col("source").alias("source_key"), "source_size", "target")
    return (m.sizes.join(got, "row", "left").join(src, F.col("source").eqNullSafe(F.col("source_key")))
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce("draws", F.lit(0).cast("long")).alias("draws"), "first_shard", "last_shard"))


def mixed_documents(m: Mix) -> DataFrame:
    """The documents of ``m``, each row once for each of its draws (a mix of whole
    documents, ``block_words=None``), in the order of the shards and of each shard's
    local shuffle. Draws find their rows by file and place in the file."""
    places = (shard_rows(m).select("row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
              .join(m.sizes.select("row", F.col("__file").alias("__drawn_file"), F.col("__place").alias("__drawn")), "row").drop("row"))
    places = C.stored(places)
    rows = m.docs.select(F.struct("*").alias("__doc"), *C.place(m.docs)).join(places, (F.col("__place") == F.col("__drawn")) & (F.col("__file") == F.col("__drawn_file")))
    return rows.orderBy("__shard", "__slot").select("__doc.*")


def shard_rows(m: Mix) -> DataFrame:
    """The draws with their place after the local shuffle of each shard, which
    holds about ``shard_draws`` rows."""
    return m.draws.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("order_key", "source_no", "draw")) - 1)
