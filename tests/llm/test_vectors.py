import numpy as np
import pytest
from brute import Sets
from pyspark.sql import functions as F

from relflow.llm import forest, pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """vec rows -> (links, component) by all pairs; rows: (id, vector)."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    links, uf = {i: 0 for i, _ in ok}, Sets()
    for n, (i, a) in enumerate(ok):
        uf.find(i)
        for j, b in ok[:n]:
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                uf.join(i, j)
    return links, {i: uf.find(i) for i, _ in ok}


def table(n=300, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 10, 8))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + r.normal(size=8) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[5][1]) for i in range(150)]                            # a third are copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] + [1.0] * 7), (2004, [None] + [1.0] * 7),
             (2005, [1.0, 2.0]), (None, rows[5][1]), (2006, [2 * x for x in rows[5][1]]), (2007, [1e30 * x for x in rows[7][1]]), (2008, [])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumnRenamed("label", "near")


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_all_pairs(spark, block):
    rows = table()
    links, comp = brute(rows)
    # every pivot in the description: all pairs are candidates, and the result is exact
    out = pivots.near_vectors(frame(spark, rows), length=64, shared=1, block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        i = r["vec_id"]
        assert r["n_links"] == links.get(i, 0), i
        assert r["component_id"] == comp.get(i, i), i
        assert r["kept"] == (i is not None and comp.get(i, i) == i)


def test_recall_of_the_index(spark):
    rows = table(600, 3)
    links, _ = brute(rows)
    out = pivots.near_vectors(frame(spark, rows)).collect()
    got = {r["vec_id"]: r["n_links"] for r in out if r["vec_id"] is not None}
    assert all(got[i] <= n for i, n in links.items())
    assert sum(got[i] for i in links) >= 0.9 * sum(links.values())


@pytest.mark.parametrize("pair_cosine", [0.92, 0.95])
def test_recall_on_a_noisy_family_with_a_third_of_all_rows(spark, pair_cosine):
    r = np.random.default_rng(4)
    n, d = 12000, 64
    x = unit_rows(r.normal(size=(n, d)))
    x[::3] = unit_rows(np.sqrt(pair_cosine) * x[0] + np.sqrt(1 - pair_cosine) * x[::3])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(8)
    out = pivots.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    u = unit_rows(x.astype(np.float64))
    want = np.concatenate([(u[s:s + 2000] @ u.T >= 0.9).sum(axis=1) - 1 for s in range(0, n, 2000)])
    got = out["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_descriptions_follow_the_pivots_density():
    r = np.random.default_rng(5)
    for n in (10 ** 4, 10 ** 6, 10 ** 8):
        drawn = unit_rows(r.normal(size=(2 * int(n ** 0.5), 64)))
        x = unit_rows(r.normal(size=(1000, 64)))
        near = pivots.fitting_length(drawn, [(x[:500], pivots._neighbours(x[:500], 0.9, 1))], 6, 2)
        a, b = (pivots._nearest(v, drawn, near) for v in (x[500:], pivots._neighbours(x[500:], 0.9, 2)))
        assert near and pivots._found(a, b, 2) >= 0.94


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_equal_brute_force_with_all_leaves(spark):
    rows = table()
    ok = {i: np.array(v, np.float64) for i, v in rows if i in brute(rows)[0]}
    out = forest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, recall=1, leaf_rows=40, least=4, part_rows=20).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ok if i % 10 == 0}
    for q, found in got.items():
        score = {i: ok[q] @ v / np.sqrt((ok[q] @ ok[q]) * (v @ v)) for i, v in ok.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [round(s, 9) for _, s in found] == [round(score[i], 9) for i in best]
        copies = [i for i, s in found if round(s, 12) == 1]
        assert copies == sorted(copies)
        assert all(abs(score[i] - s) < 1e-12 for i, s in found)


def test_recall_of_the_forest_and_few_candidates(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    out = forest.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5]) & set(out[out.query_id == q].vec_id))
    assert hit >= 0.9 * 5 * 60
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    rows = forest.nearest(few, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 0.0)]


def test_equal_cosines_go_to_the_smaller_id(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=16).astype(np.float32)
    # one direction: every vector is a power-of-two multiple of the query
    df = spark.createDataFrame([(i, (v * np.float32(2.0) ** (i % 60 - 30)).tolist(), 0) for i in range(1, 601)] + [(0, v.tolist(), 0)], SCHEMA)
    out = forest.nearest(df.repartition(6), F.col("vec_id") == 0).collect()
    assert [x["vec_id"] for x in sorted(out, key=lambda x: x["rank"])] == [1, 2, 3, 4, 5]


def scored_rows(x, every):
    """Recall of 5 neighbours, and how many rows of ``x`` a query scores on average, by the
    operator's own steps on one machine."""
    n, trees, rng = len(x), 12, np.random.default_rng(0)
    depth = int(np.ceil(np.log2(n / 128)))
    f = forest.grow(x[rng.choice(n, min(n, 65_536), replace=False)], trees, depth, 16, 11)
    at = f.leaves(x)
    counts = np.bincount(at.ravel(), minlength=trees << depth).tolist()
    asked = np.arange(0, n, every)
    true = []
    for q in asked:
        s = x @ x[q]
        s[q] = -2
        true.append(np.argpartition(-s, 5)[:5])
    tune = asked[::2][:128]
    want = forest.budget(f, counts, x[tune], [(i, at[j].tolist()) for i, q in enumerate(tune) for j in true[list(asked).index(q)]], 0.95)
    hit, rows = 0, 0
    for q, best in zip(asked, true):
        leaves, last = f.search(x[q], counts, want)
        taken = np.zeros(trees << depth, bool)
        taken[leaves] = True
        # all leaves nearer than the last one were taken, so one number tells a row's first visit
        assert taken[f.nearer(x[q], last) & (np.array(counts) > 0)].all()
        met = taken[at].any(axis=1)
        hit += met[best].sum()
        rows += met.sum()
    return hit / (5 * len(asked)), rows / len(asked) / n


def test_rows_scored_for_a_query():
    r = np.random.default_rng(6)
    recall, share = scored_rows(unit_rows(r.normal(size=(4000, 64))), 20)
    assert recall >= 0.9 and share < 1
    centres = r.normal(size=(500, 64))
    recall, share = scored_rows(unit_rows(centres[r.integers(0, 500, 100_000)] + 0.3 * r.normal(size=(100_000, 64))), 1000)
    assert recall >= 0.9 and share < 0.05


def test_a_query_takes_the_queues_leaves_and_meets_each_row_once():
    r = np.random.default_rng(7)
    x = unit_rows(np.concatenate([r.normal(size=(900, 16)), np.round(r.normal(size=(100, 16)))]))
    f = forest.grow(x, 5, 6, 4, 3)
    at = f.leaves(x)
    counts = np.bincount(at.ravel(), minlength=5 << 6)
    queries, bits = x[::50], []
    for side, q in zip(f.sides(queries), queries):
        for want in (1.0, 300.0, 2000.0, np.inf):
            taken = f.taken(side, counts, want)
            assert set(np.flatnonzero(taken).tolist()) == set(f.search(q, counts.tolist(), want, side)[0])
        bits.append(np.packbits(f.taken(side, counts, 300.0)).tobytes())
    members = forest._Members(np.arange(1000)[::-1].copy(), x, at, len(counts), 6)
    i, j, near = members.best(queries, bits)
    for n, q in enumerate(queries):
        taken = np.unpackbits(np.frombuffer(bits[n], np.uint8)).astype(bool)
        own = np.flatnonzero(taken[at].any(axis=1))
        best = own[np.lexsort((members.ids[own], -np.round(x[own] @ q, 12)))][:6]
        assert len(own) < 1000 and j[i == n].tolist() == best.tolist() and np.allclose(near[i == n], x[best] @ q)


def test_rows_and_queries_are_copied_once_for_each_block_of_the_other_side():
    rb, qb = forest.cell_counts(720_000, 14_400, 352, 6400, 65_536)
    assert rb >= 11 and rb * qb <= 128
    # one row for each query and leaf came to 60,000,000 before
    assert 720_000 * qb + 14_400 * rb < 5_000_000
    assert forest.cell_counts(10, 1, 352, 6400, 65_536) == (1, 1) and forest.cell_counts(0, 0, 4, 1, 65_536) == (1, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pivots.near_vectors(none).count() == 0
    assert forest.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    bad = spark.createDataFrame([(1, None, 0), (50, [0.0], 0)], SCHEMA)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivots.near_vectors(bad).collect()) == [(1, 0, 1), (50, 0, 50)]
    assert forest.nearest(bad, F.col("vec_id") % 50 == 0).count() == 0
