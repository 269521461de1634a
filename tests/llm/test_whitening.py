import numpy as np
import pytest

from relflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, d):
    """vec rows -> (fit list, mean, eigenvalues, eigenvectors, [(id, x)])."""
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and len(v) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64).reshape(-1, d)
    c = fit - fit.sum(0) / len(fit)
    w, v = np.linalg.eigh(c.T @ c / len(fit))
    return fit, fit.sum(0), w[::-1], v[:, ::-1], kept


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)


def check(spark, rows, d, k=4, vectors=True):
    fit, sums, w, v, kept = brute(rows, d)
    out = whitening.whitened_rows(frame(spark, rows).repartition(3)).collect()
    assert len(out) == k * len(kept)
    n, at = len(fit), {}
    for r in out:
        at.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    sign = {}
    for i, x in kept:
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        y = (np.array(x) - sums / n) @ v[:, :k] / np.sqrt(w[:k])
        for c in range(1, k + 1):
            same = [r for r in at[i][c] if r["deviation"] == dev]
            assert same
            r = same[0]
            assert r["n"] == n and r["explained"] == pytest.approx(w[c - 1] / w.sum(), rel=1e-9) and r["identity_error"] < 1e-9
            if vectors and abs(y[c - 1]) > 1e-6:
                s = sign.setdefault(c, np.sign(y[c - 1] * r["whitened"]))
                assert r["whitened"] == pytest.approx(s * y[c - 1], rel=1e-6, abs=1e-7)


def table(n, d, seed=0, scale=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (scale if scale is not None else 1)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_equals_eigh(spark):
    check(spark, table(400, 48), 48)            # no gap after the fourth
    check(spark, table(300, 40, 1, np.geomspace(30, 0.05, 40)), 40)
    check(spark, table(200, 3, 2), 3, k=3)


def test_copies_nulls_and_zeros(spark):
    rows = table(120, 8, 3)
    rows += [(1000 + i, rows[5][1]) for i in range(60)]                     # a third are copies: once in the fit list
    rows += [(3, rows[4][1]), (None, rows[9][1]), (2000, [0.0] * 8), (2001, None), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8),
             (2004, [float("-inf")] * 8), (2005, [1.0] * 3), (2006, [])]
    check(spark, rows, 8)


def test_low_rank_equal_and_empty(spark):
    r = np.random.default_rng(5)
    two = r.integers(-3, 4, size=(80, 2)) @ r.integers(-2, 3, size=(2, 12))
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(two)], 12, k=2)
    assert whitening.whitened_rows(frame(spark, [(i, [0.5] * 6) for i in range(9)])).count() == 0
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])]):
        out = whitening.whitened_rows(frame(spark, rows))
        assert out.count() == 0 and out.columns[:7] == COLUMNS
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0])], 2, k=1)


def test_tied_eigenvalues(spark):
    """All unit vectors: one eigenvalue, many times, wider than the block."""
    rows = [(i, [1.0 if j == i else 0.0 for j in range(50)]) for i in range(50)]
    check(spark, rows, 50, vectors=False)


def test_clustered_spectrum_widens_the_block(spark):
    """More close eigenvalues than the block has columns."""
    rows = table(700, 72, 6, np.concatenate([1 + np.arange(50)[::-1] * 1e-3, np.full(22, 0.2)]))
    check(spark, rows, 72)


def test_huge_components(spark):
    rows = table(50, 6, 7) + [(500, [1e30] + [0.0] * 5), (501, [1e18] * 6)]
    out = whitening.whitened_rows(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in out} == set(range(50)) | {500, 501} and all(r["deviation"] is None for r in out if r["vec_id"] == 500)
    check(spark, table(50, 6, 8, 2.0**13), 6)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F
    df = frame(spark, table(60, 6))
    more = df.select("*", *[F.lit("z").alias(c) for c in ("n", "component", "deviation", "x", "v")])
    key = lambda r: (r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9))
    assert sorted(map(key, whitening.whitened_rows(more).collect())) == sorted(map(key, whitening.whitened_rows(df).collect()))


def test_registered_query(spark):
    from relflow.llm.queries import QUERIES
    out = QUERIES["op11_chebyshev_whitening"](spark, "/root/testdata/sf0.001")
    assert out.columns[:7] == COLUMNS
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    fit, sums, w, v, kept = brute(rows, 64)
    got = out.collect()
    assert len(got) == 4 * len(kept)
    assert all(r["explained"] == pytest.approx(w[r["component"] - 1] / w.sum(), rel=1e-9) for r in got)
