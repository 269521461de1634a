"""Exact maximum-inner-product top-K with loss-free LEMP pruning.

Plan: users are dealt to shares of at most ``SHARE_BYTES`` of vectors and lists, each
one task, which holds its users with the K best found so far. All items stream past them
by length, longest first, in blocks of at most ``relflow.topk.maxBlockBytes`` (8 MiB) of
vectors. So a user is shuffled once, an item once a share, and a user's one list leaves its task;
what is written does not grow with users times blocks. Nothing but counts passes
the driver; there is no cross join and no broadcast of items.

Inside a block items are in buckets of ``bucket_size`` (by length). A batch of users
meets runs of buckets, each with the users' k-th scores before the run:

* bucket stop: a user whose k-th score ``theta`` exceeds
  ``|u| * max_len(run)`` is done with this and every later bucket;
* ``prune="length"``: skip items with ``|u| * |p| < theta``;
* ``prune="coord"``: skip items with ``u_f p_f + |u'| |p'| < theta``, ``f`` the user's
  largest coordinate and ``u'``, ``p'`` the vectors without it;
* ``prune="incr"``: the same with the ``n`` largest user coordinates;
* ``prune="lc"/"li"``: per bucket, length pruning if ``max_len > t * min_len``,
  else coord / incr (LEMP's LC and LI; default ``LI(5, 2.5)``).

Rest lengths are sums of squares of the other coordinates, so they carry only
relative rounding errors, and every comparison leaves a margin above the error
of a product of ``d`` terms: pruning never drops a true top-K item, so every
strategy returns the brute-force result (ties: higher score, then higher item id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.functions import vectors as V
from relflow.operators.meeting import stored
from relflow.plans.ordered_scan import Channel, ordered_scan

SHARE_BYTES, COPIED = 256 << 20, 512 << 20      # users' vectors and lists in a task; bytes of copied items that are always allowed
EPS = float(np.finfo(np.float64).eps)
RUN = 1024              # items that a batch of users meets at once
TRIED, USELESS = 32, 0.75       # users that a run's filter is tried on; it goes on if it keeps a smaller share of their pairs


# --------------------------------------------------------------- G1, G7

def length_buckets(items: DataFrame, size: int, id_col: str = "item_id", col: str = "factors") -> DataFrame:
    """Items by length descending (ties: id descending), cut into buckets of
    ``size`` (G1): ``item_id, norm, rank, bucket, bucket_max, bucket_min``.
    The rank is a skew-safe ordered scan over one key (no single-task window)."""
    d = items.select(F.col(id_col), F.sqrt(V.sq_norm(F.col(col))).alias("norm"))
    d = d.withColumn("_g", F.lit(0)).withColumn("_nn", -F.col("norm")).withColumn("_nid", -F.col(id_col))
    r = ordered_scan(d, ["_g"], ["_nn", "_nid"], [Channel("_c", a=F.lit(1.0), b=F.lit(1.0))],
                     keep=[id_col, "norm"])
    r = r.select(id_col, "norm", (F.col("_c") - 1).cast("long").alias("rank"))
    r = r.withColumn("bucket", F.floor(F.col("rank") / F.lit(size)).cast("long"))
    ext = r.groupBy("bucket").agg(F.max("norm").alias("bucket_max"), F.min("norm").alias("bucket_min"))
    return r.join(ext, "bucket").select(id_col, "norm", "rank", "bucket", "bucket_max", "bucket_min")


def focus_set(users: DataFrame, n: int, col: str = "factors", id_col: str = "user_id") -> DataFrame:
    """Focus coordinates per user (G7): indices of the ``n`` largest squared
    coordinates (ties: lower index), first = the focus coordinate. All
    coordinates are candidates (the reference leaves out the last)."""
    s = F.array_sort(F.transform(F.col(col), lambda x, i: F.struct((-(x * x)).alias("k"), i.alias("i"))))
    return users.select(F.col(id_col), F.transform(F.slice(s, 1, n), lambda t: t["i"]).alias("focus"))


# ------------------------------------------------------------ numpy core

def _topk_merge(best, found, rows, new_s, first, mask):
    """Put the scores of some items (columns from ``first`` on; those of ``mask``) into
    the k best scores of ``rows``, and note in ``found`` each one that reaches its row's
    k-th score, ties included: a row's list is among them."""
    k = best.shape[1]
    take = new_s >= best[rows, :1]
    if mask is not None:
        take &= mask
    row, col = np.nonzero(take)
    if not len(row):
        return
    s = new_s[row, col]
    count = np.bincount(row, minlength=len(rows))
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    wide = np.full((len(rows), k + count.max()), -np.inf)
    wide[:, :k] = best[rows]
    wide[row, k + place] = s
    best[rows] = np.partition(wide, wide.shape[1] - k, axis=1)[:, -k:]      # the k-th score in front
    stay = s >= best[rows[row], 0]
    found.append((rows[row[stay]], first + col[stay], s[stay]))


def _lists(best, found, ids):
    """The k best of what was found (score desc, id desc): scores and columns of each
    row, missing ones -inf and -1."""
    m, k = best.shape
    row, col, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    stay = s >= best[row, 0]
    row, col, s = row[stay], col[stay], s[stay]
    order = np.lexsort((ids[col], s, row))[::-1]        # rows descending, best first
    row = row[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    order, row, rank = order[rank < k], row[rank < k], rank[rank < k]
    out_s, out_c = np.full((m, k), -np.inf), np.full((m, k), -1, dtype=np.int64)
    out_s[row, rank], out_c[row, rank] = s[order], col[order]
    return out_s, out_c


def _slack(unorm, pnorm, theta, d):
    """Above the rounding error of a product of two vectors of ``d`` coordinates
    and of its bound."""
    return (4 * d + 32) * EPS * (np.outer(unorm, pnorm) + np.abs(np.where(np.isfinite(theta), theta, 0.0))[:, None])


def _focus(U, n):
    """The ``n`` largest coordinates of each user, the others zero, and the length of those."""
    focus = np.zeros(U.shape)
    np.put_along_axis(focus, np.argsort(-(U * U), axis=1, kind="stable")[:, :n], 1.0, axis=1)
    return focus, U * focus, np.sqrt(np.einsum("ij,ij->i", U * (1.0 - focus), U))


def _bucket_filter(prune, focus, unorm, theta, P, P2, pnorm, t, bucket_size, d):
    """Mask (users x items) of pairs that may still enter the top-k, for the items of
    some buckets: each bucket by its own strategy."""
    limit = (theta - _slack(unorm, pnorm[:1], theta, d)[:, 0])[:, None]     # the longest item's margin
    by_rest = np.full(len(P), prune != "length")
    if prune in ("lc", "li"):
        first = np.arange(0, len(P), bucket_size)
        by_rest = np.repeat(pnorm[first] <= t * pnorm[np.minimum(first + bucket_size, len(P)) - 1], bucket_size)[:len(P)]
    if not by_rest.any():
        return np.outer(unorm, pnorm) >= limit
    at = slice(None) if by_rest.all() else np.flatnonzero(by_rest)
    mark, head, rest = focus
    far = (1.0 - mark) @ P2[at].T
    np.sqrt(far, out=far)
    far *= rest[:, None]
    far += head @ P[at].T
    if by_rest.all():
        return far >= limit
    mask = np.outer(unorm, pnorm) >= limit
    mask[:, at] = far >= limit
    return mask


def _scan_block(U, theta0, ids, P, pnorm, k, prune, bucket_size, n_focus, t, P2=None):
    """The K best items of one block (lengths descending) for some users that reach
    ``theta0``, a score each user's K-th best is known to have, and the number of full
    products taken. Buckets are taken in runs: a short one first, whose scores give a
    bound, then of four times the length, up to ``RUN`` items. A run's filter is tried on
    a few users, and left out for the others where it keeps nearly all of their pairs."""
    at, sc, scored = _scan_places(U, theta0, ids, P, pnorm, k, prune, bucket_size, n_focus, t, P2)
    return sc, np.where(at < 0, np.iinfo(np.int64).min, ids[at]), scored


def _scan_places(U, theta0, ids, P, pnorm, k, prune, bucket_size, n_focus, t, P2=None):
    """``_scan_block`` with the items' places in the block (-1: none)."""
    m, nb, d = len(U), len(ids), U.shape[1]
    unorm = np.sqrt(np.einsum("ij,ij->i", U, U))
    # as if k scores of ``theta0`` were found: lower ones cannot enter the user's list
    best, found = np.repeat(np.asarray(theta0, dtype=np.float64)[:, None], k, axis=1), []
    scored = np.zeros(m, dtype=np.int64)
    rests = prune not in (None, "length")
    if rests:
        focus = _focus(U, min(1 if prune in ("coord", "lc") else n_focus, d))
        P2 = P * P if P2 is None else P2
    s, run = 0, -(-2 * k // bucket_size) * bucket_size
    while s < nb:
        e = min(s + run, nb)
        theta = best[:, 0].copy()
        rows = np.arange(m)
        if prune is not None:
            rows = np.flatnonzero(unorm * pnorm[s] >= theta - _slack(unorm, pnorm[s:s + 1], theta, d)[:, 0])
            if not len(rows):
                break          # lengths only decrease: no later bucket can help
        mask = None
        if prune is not None:
            keeps = lambda r: _bucket_filter(prune, tuple(f[r] for f in focus) if rests else None, unorm[r], theta[r], P[s:e],
                                             P2[s:e] if rests else None, pnorm[s:e], t, bucket_size, d)
            few = rows[::-(-len(rows) // TRIED)]
            mask = keeps(few)
            if len(few) < len(rows):
                mask = keeps(rows) if np.count_nonzero(mask) < USELESS * mask.size else None
        sc = (U if len(rows) == m else U[rows]) @ P[s:e].T
        scored[rows] += e - s if mask is None else np.count_nonzero(mask, axis=1)
        _topk_merge(best, found, rows, sc, s, mask)
        if sum(len(f[0]) for f in found) > 16 * m * k:      # many ties: down to the lists
            out_s, out_c = _lists(best, found, ids)
            r, j = np.nonzero(out_c >= 0)
            found = [(r, out_c[r, j], out_s[r, j])]
        s, run = e, max(run, min(4 * run, RUN // bucket_size * bucket_size))
    sc, at = _lists(best, found, ids)
    return at, sc, scored


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    """Lists of equal length as the rows of a matrix (null coordinates: not a number)."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, len(vectors.flatten()) // max(rows, 1))


class _Share:
    """Some users of a share and their lists: scores (best first) and item ids."""

    def __init__(self, users: pa.Array, x: np.ndarray, k: int):
        self.users, self.x = users, x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.scores, self.items = np.full((len(x), k), -np.inf), np.full((len(x), k), np.iinfo(np.int64).min)

    def meet(self, ids, P, pnorm, P2, k, prune, bucket_size, n_focus, t) -> None:
        """A block, lengths descending."""
        for s in range(0, len(self.x), 1024):
            rows = np.arange(s, min(s + 1024, len(self.x)))
            theta = self.scores[rows, -1]
            if prune is not None:       # all of the block's items are too short for the others
                rows = rows[self.norm[rows] * pnorm[0] >= theta - _slack(self.norm[rows], pnorm[:1], theta, P.shape[1])[:, 0]]
                theta = self.scores[rows, -1]
            if not len(rows):
                continue
            sc, it, _ = _scan_block(self.x[rows], theta, ids, P, pnorm, k, prune, bucket_size, n_focus, t, P2)
            new = np.flatnonzero(sc[:, 0] > -np.inf)
            rows = rows[new]
            sc, it = np.concatenate([self.scores[rows], sc[new]], axis=1), np.concatenate([self.items[rows], it[new]], axis=1)
            order = np.lexsort((it, sc), axis=1)[:, :-k - 1:-1]
            self.scores[rows], self.items[rows] = np.take_along_axis(sc, order, axis=1), np.take_along_axis(it, order, axis=1)

    def lists(self, final: bool):
        for s in range(0, len(self.x), 1024):
            i, j = np.nonzero(np.isfinite(self.scores[s:s + 1024]))
            item = self.items[s + i, j]
            rank = (j + 1).astype(np.int64) if final else np.zeros(len(j), np.int64)
            yield pa.RecordBatch.from_arrays([self.users.take(pa.array(s + i)), pa.array(item, mask=item == np.iinfo(np.int64).min),
                                              pa.array(self.scores[s + i, j]), pa.array(rank)], names=["user", "item", "score", "rank"])


def _scan_parts(batches, k, prune, bucket_size, n_focus, t, final, limit):
    """Rows sorted by ``part``, a share's users (even) before its items (odd), which come
    longest first: the lists of each share's users, with ranks if ``final``. Vectors with a
    coordinate that is no finite number have no scores."""
    none_id = np.iinfo(np.int64).min
    now, shares, ids, vecs = None, [], [], []

    def meet():
        if ids and shares:
            P, at = np.concatenate(vecs), np.concatenate(ids)
            norm = np.sqrt(np.einsum("ij,ij->i", P, P))
            order = np.argsort(-norm, kind="stable")
            P, at, norm = P[order], at[order], norm[order]
            P2 = P * P if prune not in (None, "length") else None
            for s in shares:
                s.meet(at, P, norm, P2, k, prune, bucket_size, n_focus, t)
        ids.clear()
        vecs.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if now != key[a] >> 1:
                meet()
                for s in shares:
                    yield from s.lists(final)
                now, shares = key[a] >> 1, []
            part = batch.slice(a, b - a)
            if part.column("factors").null_count:       # users without a vector
                part = part.filter(part.column("factors").is_valid())
            x = _matrix(part.column("factors"), part.num_rows)
            sound = np.isfinite(x).all(axis=1)
            if not sound.any():
                continue
            if not key[a] & 1:
                shares.append(_Share(part.column("id").take(pa.array(np.flatnonzero(sound))), x[sound], k))
                continue
            own, x = part.column("id").fill_null(none_id).to_numpy()[sound], x[sound]
            held = sum(len(i) for i in ids)
            for s in range(0, len(x), limit):
                if held and held + len(x[s:s + limit]) > limit:
                    meet()
                    held = 0
                ids.append(own[s:s + limit])
                vecs.append(x[s:s + limit])
                held += len(ids[-1])
    meet()
    for s in shares:
        yield from s.lists(final)


def share_count(users: int, items: int, dim: int, k: int, share_rows: int, max_share_rows: int, cells: int, least_shares: int) -> int:
    """Shares of bounded size, and of the number that is wanted as many as copy no more
    bytes of items than there are of users, ``COPIED`` aside."""
    most = max(1, min(max_share_rows, SHARE_BYTES // (8 * dim + 24 * k + 32)))
    wanted = max(-(-users // share_rows), min(least_shares, -(-users * 16 // share_rows)))
    affordable = (users * (8 * dim + 16) + COPIED) // max(1, items * (8 * dim + 16))
    return max(1, -(-users // most), min(wanted, cells, affordable))


def top_k(users: DataFrame, items: DataFrame, k: int, prune: str | None = None, bucket_size: int = 10,
          n_focus: int = 5, t: float = 2.5, user_col: str = "user_id", item_col: str = "item_id",
          col: str = "factors", max_block_rows: int | None = None, share_rows: int = 16384,
          max_share_rows: int = 409_600, cells: int = 4096, least_shares: int = 64) -> DataFrame:
    """Exact top-K items per user by inner product.

    Output rows ``user_id, rank (1..K), item_id, score``; fewer than K rows
    when there are fewer items. ``prune`` in None, "length", "coord", "incr",
    "lc", "li"; all give the same rows. Shares have ``share_rows`` users, fewer where
    ``least_shares`` tasks would not be reached, and up to ``max_share_rows`` where more
    than ``cells`` shares or too many copies of the items would come of it (``share_count``).
    A task ranks its users' lists, unless a user has several vectors.
    """
    spark = users.sparkSession
    from relflow.operators.factors import vector_size
    from relflow.session import scan_partitions
    it = items.select(F.col(item_col).cast("long").alias("id"), F.col(col).alias("factors")).where(F.col("factors").isNotNull())
    us = users.select(F.col(user_col).cast("long").alias("id"), F.col(col).alias("factors"))
    n_items = it.count()
    if not n_items:
        return users.select(F.col(user_col), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias(item_col),
                            F.lit(0.0).alias("score")).limit(0)
    counts = us.groupBy("id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    n_users, final = counts[0], counts[1] <= 1
    dim = max(1, vector_size(items, col))
    max_bytes = int(spark.conf.get("relflow.topk.maxBlockBytes", str(8 << 20)))
    limit = max_block_rows or max(1, max_bytes // (8 * dim + 16))
    shares = share_count(n_users, n_items, dim, k, share_rows, max_share_rows, cells, least_shares)
    share = F.pmod(F.xxhash64("id"), F.lit(shares))
    part = lambda share, kind: (share.cast("long") * 2 + kind).alias("part")
    mine = us.select(part(share, 0), "id", F.lit(0.0).alias("short"), "factors")
    # few items can be many copies: dealt to all tasks, each length taken once
    theirs = (it.repartition(scan_partitions(spark), "id").withColumn("short", -F.sqrt(V.sq_norm(F.col("factors"))))
              .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(part(F.col("share"), 1), "id", "short", "factors"))
    both = (mine.unionByName(theirs).repartitionById(shares, F.shiftright("part", 1).cast("int"))
            .sortWithinPartitions("part", "short").drop("short"))
    lists = both.mapInArrow(lambda batches: _scan_parts(batches, k, prune, bucket_size, n_focus, t, final, limit),
                            "user long, item long, score double, rank long")
    best = Window.partitionBy("user").orderBy(F.desc("score"), F.desc("item"))      # K rows for each vector of a user
    kind = {c: f.schema[c].dataType for c, f in ((user_col, users), (item_col, items))}
    if not final:
        lists = lists.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return (lists
            .select(F.col("user").cast(kind[user_col]).alias(user_col), "rank", F.col("item").cast("long").alias(item_col), "score"))


# ----------------------------------------------------------- G8, G13

def merge_top_k(partials: DataFrame, k: int, request_col: str = "request_id", item_col: str = "item_id",
                score_col: str = "score", target_col: str | None = "target", ts_col: str | None = "ts") -> DataFrame:
    """Merge partial top-K lists of one request (G8): all partial rows, best
    score per item (de-duplication), the K best (score desc, item id desc);
    target = max target, ts = max ts over the partials. Groups are bounded by
    K times the number of partial lists."""
    # dealt by request once: its items, its list and its meta need no other shuffle
    partials = partials.repartition(request_col)
    best = partials.groupBy(request_col, item_col).agg(F.max(score_col).alias(score_col))
    w = Window.partitionBy(request_col).orderBy(F.col(score_col).desc(), F.col(item_col).desc())
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    extra = []
    if target_col:
        extra.append(F.max(target_col).alias(target_col))
    if ts_col:
        extra.append(F.max(ts_col).alias(ts_col))
    if extra:
        meta = partials.groupBy(request_col).agg(*extra)
        top = top.join(meta, request_col)
    return top


def recommend(requests: DataFrame, users: DataFrame, items: DataFrame, k: int, prune: str | None = "li",
              user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """Top-K items for the requested users (G13): rows and the text form
    ``user:(item,score),...``."""
    req = users.join(requests.select(user_col).distinct(), user_col, "left_semi")
    req = stored(req)       # read several times
    tk = top_k(req, items, k, prune=prune, user_col=user_col, item_col=item_col)
    return tk


def recommendation_text(ranked: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", item_col, "score"))),
                        lambda s: F.format_string("(%d,%s)", s[item_col], s["score"].cast("string")))
    return ranked.groupBy(user_col).agg(F.concat(F.col(user_col).cast("string"), F.lit(":"),
                                                 F.array_join(pairs, ",")).alias("text"))
