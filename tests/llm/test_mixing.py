from collections import Counter

import numpy as np
import pytest
from brute import DOCS, WORD
from pyspark.sql import functions as F

from relflow.llm import mixing


def rows(n=400):
    out = []
    for i in range(n):
        source = [None, "a", "b", "hot", "hot", "hot", "z", "\U0001F600", "é"][i % 9]
        out.append((i if i % 50 else None, None if i % 41 == 0 else "w\x0b " * (i % 37), "en", source, 0))
    return out + [(7, "one two", "en", "b", 0)] * 3 + [(900, "w " * 20000, "en", "a", 0), (901, "", "en", "empty", 0)]


def water(sizes, weights, cap):
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        give = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if give[i] > cap * sizes[i]]
        for i in (over or free):
            out[i] = cap * sizes[i] if over else give[i]
        if not over:
            return out
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@pytest.mark.parametrize("block", [256, 7, None])
def test_targets_and_quotas(spark, block):
    data = rows()
    df = spark.createDataFrame(data, DOCS).withColumnRenamed("lang", "draw").withColumnRenamed("n_chars", "size")
    made = mixing.mix(df, block_words=block, shard_draws=40, bin_blocks=8)
    got = mixing.taken(made).collect()
    assert len(got) == len(data)
    size = {}
    for i, t, _, s, _ in data:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    sums = {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
    assert all(abs(sums[s] - want[s]) <= 0.5 for s in size)
    again = mixing.taken(mixing.mix(df.repartition(5), block_words=block, shard_draws=40, bin_blocks=8)).collect()
    key = lambda rs: sorted(((r["doc_id"] or -1), r["source"] or "", r["size"], r["taken"]) for r in rs)
    assert key(again) == key(got)


def test_shards_are_disjoint_and_even(spark):
    made = mixing.mix(spark.createDataFrame(rows(), DOCS), block_words=5, shard_draws=100)
    draws = mixing.shard_rows(made).toPandas()
    assert not draws.duplicated(["source_no", "draw"]).any()
    for _, g in draws.groupby("source_no"):
        assert sorted(g["draw"]) == list(range(len(g)))
    sizes = draws.groupby("shard").size()
    assert sizes.max() - sizes.min() <= int(np.ceil(np.log2(len(sizes)))) + 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in draws.groupby("shard"))


def test_tree_is_a_hypergeometric_split():
    quotas = [5000, 300, 7]
    source = np.repeat([0, 1, 2], quotas)
    draw = np.concatenate([np.arange(q) for q in quotas])
    firsts = []
    for seed in range(200):
        owner = mixing.SplitTree(quotas, 8, seed).owners(source, draw)
        assert (np.diff(owner[:5000]) >= 0).all()       # each shard owns a run of a source's order
        firsts.append(np.bincount(owner[source == 1], minlength=8))
    firsts = np.array(firsts)
    n, k, total = 300, sum(quotas) / 8, sum(quotas)
    assert np.allclose(firsts.mean(axis=0), n / 8, atol=2)
    assert np.allclose(firsts.var(axis=0).mean(), k * (n / total) * (1 - n / total) * (total - k) / (total - 1), rtol=0.25)


def test_counts_beyond_numpys_sampler():
    rng = np.random.default_rng(1)
    # against numpy's sampler, on counts that both take
    for good, bad, n in [(7, 500, 100), (5000, 300, 2650), (10**6, 10**8, 5 * 10**7), (1, 1, 1)]:
        ours = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(400)])
        theirs = rng.hypergeometric(good, bad, n, 20000)
        assert ours.min() >= max(0, n - bad) and ours.max() <= min(good, n)
        assert abs(ours.mean() - theirs.mean()) <= 5 * theirs.std() / 20 + 1e-9
        assert ours.std() == pytest.approx(theirs.std(), rel=0.25)
    assert mixing.hypergeometric(rng, 10, 0, 4) == 4 and mixing.hypergeometric(rng, 0, 10, 4) == 0


@pytest.mark.parametrize("kept", [0, 1 << 22])
def test_tree_of_ten_thousand_million_draws(kept):
    quotas, shards = [6 * 10**9, 4 * 10**9, 40, 0], 64
    tree = mixing.SplitTree(quotas, shards, 3)
    tree.KEPT = kept
    # the shard changes once at most between two neighbouring draws; find each shard's share of a source by bisection
    shares = []
    for s, q in enumerate(quotas):
        lo, hi = np.zeros(shards, np.int64), np.full(shards, q, np.int64)       # first draw of a shard above each
        while (lo < hi).any():
            mid = (lo + hi) // 2
            owner = tree.owners(np.full(shards, s), np.minimum(mid, q - 1))
            up = (owner <= np.arange(shards)) & (mid < q) & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
        shares.append(np.diff(lo, prepend=0))
    shares = np.array(shares)
    assert shares.sum(axis=1).tolist() == quotas and (shares >= 0).all()
    assert np.ptp(shares.sum(axis=0)) <= 7
    p = shares[0] / shares.sum(axis=0)
    assert abs(p - 0.6).max() < 6 * (0.24 * shards / 1e10) ** 0.5
    assert (len(tree.nodes) == 0) == (kept == 0)


def test_documents_get_what_their_shards_draw(spark):
    """A replay from the stored sizes alone: a source's random order, the tree's counts for
    each node and the runs of draws that they give to the shards."""
    made = mixing.mix(spark.createDataFrame(rows(), DOCS), block_words=7, shard_draws=60)
    draws = made.draws.toPandas()
    quotas = draws.groupby("source_no").size().reindex(range(made.sources.count()), fill_value=0).to_numpy()
    shards = -(-len(draws) // 60)

    def split(a, b, have):
        if b - a == 1:
            return {a: have}
        rng, mid = np.random.Generator(np.random.PCG64([17, a, b])), (a + b) // 2
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - a) // (b - a), method="marginals")
        return split(a, mid, left) | split(mid, b, have - left)

    want = split(0, shards, quotas)
    got = draws.groupby(["shard", "source_no"]).size()
    for a, have in want.items():
        assert [got.get((a, s), 0) for s in range(len(quotas))] == have.tolist()
    ends = {s: np.cumsum([want[a][s] for a in range(shards)]) for s in range(len(quotas))}
    assert all(r.shard == np.searchsorted(ends[r.source_no], r.draw, side="right") for r in draws.itertuples())
    per = draws.groupby("row").agg(taken=("words", "sum"), draws=("words", "size"), first=("shard", "min"), last=("shard", "max"))
    ids = {r["row"]: r for r in made.sizes.collect()}
    have = sorted((ids[i]["doc_id"] or -1, ids[i]["size"], *map(int, r)) for i, r in zip(per.index, per.to_numpy()))
    out = mixing.taken(made).collect()
    assert have == sorted((r["doc_id"] or -1, r["size"], r["taken"], r["draws"], r["first_shard"], r["last_shard"]) for r in out if r["draws"])
    assert all(r["taken"] == 0 and r["first_shard"] is None for r in out if not r["draws"])


def test_mixed_documents_repeat_rows_as_the_mix_says(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 7]
    df = spark.createDataFrame(data, DOCS)
    made = mixing.mix(df, block_words=None)
    out = mixing.mixed_documents(made)
    assert out.columns == df.columns
    want = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mixing.taken(made).collect()}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_mixed_documents_come_by_shard_and_local_shuffle(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), "en", "ab"[i % 2], 0) for i in range(300)], DOCS)
    made = mixing.mix(df, block_words=None, shard_draws=60)
    want = [r["doc_id"] for r in mixing.shard_rows(made).orderBy("shard", "slot").collect()]
    assert made.draws.select("shard").distinct().count() > 2
    assert [r["doc_id"] for r in mixing.mixed_documents(made).collect()] == want


def test_rows_are_found_however_the_files_are_split(spark, tmp_path):
    """The scan that reads the texts may cut the files into other tasks than the one that
    numbered the rows (executors come and go): every draw still gets its own row."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), "en", "ab"[i % 2], i) for i in range(2000)], DOCS).repartition(6).write.parquet(path)
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        made = mixing.mix(spark.read.parquet(path), block_words=None)
        want = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.taken(made).collect() if r["taken"]}
        for values in (("1", "1", "100000000"), ("40", "1", "4096")):
            for k, v in zip(keys, values):
                spark.conf.set(k, v)
            again = spark.read.parquet(path)
            made.docs = again
            out = mixing.mixed_documents(made).collect()
            got = Counter(r["doc_id"] for r in out)
            assert got == want and all(r["text"] == f"w{r['doc_id']} " * (r["doc_id"] % 7 + 1) and r["n_chars"] == r["doc_id"] for r in out)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_derived_rows_are_stored_first(spark):
    df = spark.range(40).selectExpr("id AS doc_id", "repeat('w ', int(id % 4) + 1) AS text", "'en' AS lang", "'a' AS source", "id AS n_chars",
                                    "'clash' AS row", "map('k', 1) AS __file")
    made = mixing.mix(df, block_words=None)
    assert {r["doc_id"] for r in mixing.mixed_documents(made).collect()} == {r["doc_id"] for r in mixing.taken(made).where("taken > 0").collect()}


def test_empty_table(spark):
    made = mixing.mix(spark.createDataFrame([], DOCS))
    assert mixing.taken(made).count() == 0 and made.draws.count() == 0


def test_word_count_rule(spark):
    texts = [None, "", " ", "a", "a\x0bb", "a b", "a\x85b c", "\x1c x", "é  漢\t."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(WORD.findall(t or "")) for t in texts]
