"""Pruned top-K equals brute force on random vectors of varied lengths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relflow.operators import topk as TK


def _tables(spark, seed, nu=40, ni=300, d=8):
    rng = np.random.default_rng(seed)
    U = rng.normal(size=(nu, d)) * rng.choice([0.05, 1.0, 4.0], size=(nu, 1))
    P = rng.normal(size=(ni, d)) * rng.uniform(0.2, 3.0, size=(ni, 1))
    P[5] = 0.0                                    # a zero vector
    users = spark.createDataFrame(pd.DataFrame({"user_id": np.arange(nu), "factors": list(U)}))
    items = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(ni) + 1000, "factors": list(P)}))
    return users, items, U, P


def _brute(U, P, k):
    out = {}
    for u in range(len(U)):
        sc = P @ U[u]
        order = sorted(range(len(P)), key=lambda i: (-sc[i], -(i + 1000)))[:k]
        out[u] = [(i + 1000, round(sc[i], 9)) for i in order]
    return out


@pytest.mark.parametrize("prune", [None, "length", "coord", "incr", "lc", "li"])
def test_pruning_is_loss_free(spark, prune):
    users, items, U, P = _tables(spark, 11)
    k = 10
    got = TK.top_k(users, items, k, prune=prune, bucket_size=7, n_focus=3, t=1.5).toPandas()
    exp = _brute(U, P, k)
    for u, g in got.groupby("user_id"):
        g = g.sort_values("rank")
        assert [(int(i), round(s, 9)) for i, s in zip(g.item_id, g.score)] == exp[u]


def test_k_larger_than_items_and_chunks(spark):
    users, items, U, P = _tables(spark, 12, ni=25)
    got = TK.top_k(users, items, 40, prune="li", bucket_size=4, max_block_rows=6, share_rows=9).toPandas()
    assert got.groupby("user_id").size().eq(25).all()
    exp = _brute(U, P, 40)
    for u, g in got.groupby("user_id"):
        g = g.sort_values("rank")
        assert [int(i) for i in g.item_id] == [i for i, _ in exp[u]]


@pytest.mark.parametrize("prune", [None, "li"])
@pytest.mark.parametrize("shape", [(1, 4), (1000, 30), (7, 1)])
def test_shares_of_any_size_give_the_same_rows(spark, prune, shape):
    users, items, U, P = _tables(spark, 21)
    got = TK.top_k(users, items, 6, prune=prune, max_block_rows=40, share_rows=3, max_share_rows=shape[0], cells=shape[1]).toPandas()
    exp = _brute(U, P, 6)
    assert got.user_id.nunique() == len(U)
    for u, g in got.groupby("user_id"):
        assert [(int(i), round(s, 9)) for i, s in zip(g.sort_values("rank").item_id, g.sort_values("rank").score)] == exp[u]


def _work(U, P, k, prune, bucket_size):
    norm = np.sqrt((P * P).sum(axis=1))
    order = np.argsort(-norm, kind="stable")
    sc, it, n = TK._scan_block(U, np.full(len(U), -np.inf), order, P[order], norm[order], k, prune, bucket_size, 5, 2.5)
    return sc, it, int(n.sum())


def test_pruning_saves_work():
    rng = np.random.default_rng(13)
    U, P = rng.normal(size=(30, 8)), rng.normal(size=(2000, 8)) * rng.uniform(0.2, 3.0, size=(2000, 1))
    assert _work(U, P, 5, "li", 20)[2] < _work(U, P, 5, None, 20)[2]


@pytest.mark.parametrize("prune", [None, "length", "li"])
def test_a_batch_of_users_meets_few_runs_of_buckets(monkeypatch, prune):
    rng = np.random.default_rng(17)
    U, P = rng.normal(size=(30, 8)), rng.normal(size=(2000, 8))
    merges, merge = [], TK._topk_merge
    monkeypatch.setattr(TK, "_topk_merge", lambda *a: merges.append(1) or merge(*a))
    sc, it, _ = _work(U, P, 10, prune, 10)
    assert 1 < len(merges) < 12       # one for each of 200 buckets before
    exp = _brute(U, P, 10)
    for u in range(len(U)):
        assert [(int(i) + 1000, round(s, 9)) for i, s in zip(it[u], sc[u])] == exp[u]


def test_ties_at_the_end_of_a_list_go_to_the_higher_id():
    P = np.repeat(np.array([[1.0, 0.0], [0.5, 0.5]]), 300, axis=0)
    for prune in (None, "length", "coord", "incr", "lc", "li"):
        sc, it, _ = _work(np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]), P, 7, prune, 5)
        assert it[0].tolist() == list(range(299, 292, -1)) and it[1].tolist() == list(range(599, 592, -1)) and it[2].tolist() == list(range(599, 592, -1))


@pytest.mark.parametrize("prune", ["length", "coord", "incr", "lc", "li"])
def test_dominant_coordinates_and_near_ties_are_kept(prune):
    # a user along one axis, items that differ in the last bits or by 1e-9
    rng = np.random.default_rng(3)
    for eps in (0.0, 1e-16, 1e-12, 1e-8, 1e-4):
        U = np.array([[1.0, eps, 0.0], [eps, 3.0, eps], [-1.0, eps, eps]])
        base = np.array([[1.0, 1e-8, 0], [1.0 - 1.7e-9, 0.0, 0.0], [1.0, 0.0, 1e-8], [0.0, 1.0, 0.0], [1e-9, 1.0, 1e-9], [-1.0, 0.0, 0.0]])
        P = np.concatenate([base * (1 + j * 2.0 ** -51) for j in range(5)] + [rng.normal(size=(20, 3)) * 0.9])
        want, ids, _ = _work(U, P, 3, None, 4)
        got, ids2, _ = _work(U, P, 3, prune, 4)
        assert (want == got).all() and (ids == ids2).all()


@pytest.mark.parametrize("prune", [None, "li"])
def test_many_blocks_equal_lengths_and_hot_block(spark, prune):
    rng = np.random.default_rng(5)
    U = rng.normal(size=(50, 4))
    P = rng.normal(size=(400, 4))
    P[100:300] /= np.sqrt((P[100:300] ** 2).sum(axis=1, keepdims=True))     # half of the items have one length
    P[200:260] = P[200]
    users = spark.createDataFrame(pd.DataFrame({"user_id": np.arange(50), "factors": list(U)}))
    items = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(400) + 1000, "factors": list(P)}))
    got = TK.top_k(users, items, 7, prune=prune, bucket_size=5, max_block_rows=30, share_rows=8).toPandas()
    exp = _brute(U, P, 7)
    assert got.groupby("user_id").size().eq(7).all() and got.user_id.nunique() == 50
    for u, g in got.groupby("user_id"):
        assert [round(x, 9) for x in g.sort_values("rank").score] == [x for _, x in exp[u]]
    assert TK.top_k(users, items.limit(0), 3).count() == 0


def test_recommend_makes_its_users_once(spark):
    rows = lambda n, c: spark.range(n).select(F.col("id").alias(c), F.array(F.sin("id"), F.cos("id")).alias("factors"))
    requests = spark.range(0, 40, 3).withColumnRenamed("id", "user_id")
    got = TK.recommend(requests, rows(40, "user_id"), rows(30, "item_id"), 3)
    assert "LeftSemi" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 14 * 3


def test_one_task_with_all_items_ranks_them_itself(spark):
    users, items, U, P = _tables(spark, 31)
    got = TK.top_k(users, items, 5)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()      # sorted all lists again before
    exp = _brute(U, P, 5)
    for u, g in got.toPandas().groupby("user_id"):
        assert [int(i) for i in g.sort_values("rank").item_id] == [i for i, _ in exp[u]]


def test_vectors_without_a_score_and_users_with_two_vectors(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [float("nan"), 1.0])], "user_id long, factors array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [0.5, 0.5])], "item_id long, factors array<double>")
    for prune in (None, "li"):      # a null vector failed before
        got = sorted(map(tuple, TK.top_k(users, items, 3, prune=prune).collect()))
        assert got == [(1, 1, 2, 2.0), (1, 2, 5, 1.0), (1, 3, 1, 1.0)]


def test_a_filter_that_keeps_all_is_tried_on_few_users(monkeypatch):
    rng = np.random.default_rng(19)
    U, P = rng.uniform(size=(640, 8)), rng.normal(size=(900, 8))
    asked, keeps = [], TK._bucket_filter
    monkeypatch.setattr(TK, "_bucket_filter", lambda prune, focus, unorm, *a: asked.append(len(unorm)) or keeps(prune, focus, unorm, *a))
    sc, it, _ = _work(U, P, 10, "li", 10)
    assert sum(asked) < 640 * len(asked) / 2
    exp = _brute(U, P, 10)
    assert all([int(i) + 1000 for i in it[u]] == [i for i, _ in exp[u]] for u in range(0, 640, 40))


def test_a_user_is_shuffled_once_and_has_one_list(spark):
    users, items, U, P = _tables(spark, 23)
    for prune in (None, "li"):      # a user met each block, and had a list of each, before
        got = TK.top_k(users, items, 5, prune=prune, max_block_rows=7, share_rows=16)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        exp = _brute(U, P, 5)
        for u, g in got.toPandas().groupby("user_id"):
            assert [int(i) for i in g.sort_values("rank").item_id] == [i for i, _ in exp[u]]


def test_shares_are_bounded_and_copy_few_items():
    shares = lambda *a: TK.share_count(*a, 16384, 409_600, 4096, 64)
    for users, items, k in ((10, 10, 10), (900_000, 120_000, 10), (5_400_000, 720_000, 10), (5_400_000, 720_000, 100), (0, 1, 1)):
        n = shares(users, items, 64, k)
        assert n >= 1 and users / n * (8 * 64 + 24 * k) <= TK.SHARE_BYTES
    # users met 46 blocks before: 46 copies of 5,400,000 vectors
    assert 5_400_000 + shares(5_400_000, 720_000, 64, 10) * 720_000 < 4 * 5_400_000
