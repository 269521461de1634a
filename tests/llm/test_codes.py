import hashlib

import numpy as np
import pytest

from relflow.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, d, scale=1024):
    """The contract by Python integers: rows (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in v], lab) for i, v, lab in rows
            if v is not None and None not in v and np.isfinite(v).all() and len(v) == d]
    kept = [(i, [max(min(c, 2**63 - 1), -2**63) for c in x], lab) for i, x, lab in kept]
    kept.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    w = -(-d // 4)
    parts = [[(x + [0] * (4 * w - d))[p * w:(p + 1) * w] for p in range(4)] for _, x, _ in kept]
    books = [[list(parts[r][p]) for r in range(min(256, len(kept)))] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x[p], e)), n) for n, e in enumerate(books[p])) for x in parts]
    for _ in range(4):
        for p in range(4):
            own = [n for _, n in assign(p)]
            for n in set(own):
                mine = [x[p] for x, o in zip(parts, own) if o == n]
                books[p][n] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [assign(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(final[p][r][0] for p in range(4)) for r in range(len(kept))]
    total = {}
    for (_, _, lab), e in zip(kept, errors):
        total.setdefault(lab, []).append(e)
    fits = {lab: sum(e) if max(e) < 2**63 and sum(e) < 2**63 else None for lab, e in total.items()}
    return sorted([(str(i), "".join(f"{final[p][r][1]:02x}" for p in range(4)), errors[r] if errors[r] < 2**63 else None, fits[lab], sha)
                   for r, (i, _, lab) in enumerate(kept)], key=repr)


def check(spark, rows, d):
    out = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted([(str(r[0]), *r[1:]) for r in out], key=repr) == brute(rows, d)


def table(n, d, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 8, d))
    return [(int(i), [float(np.float32(c)) for c in base[i % len(base)] + r.normal(size=d) * 0.1], int(i % 3) if i % 5 else None) for i in r.permutation(n)]


@pytest.mark.parametrize("n,d", [(500, 8), (100, 16), (300, 6)])
def test_equals_brute(spark, n, d):
    check(spark, table(n, d), d)


def test_copies_ties_nulls(spark):
    rows = table(400, 8, 3)
    rows += [(1000 + i, rows[5][1], 9) for i in range(200)]                 # a third are copies
    rows += [(0, rows[7][1], 1), (0, rows[7][1], 1), (None, rows[9][1], None), (None, rows[8][1], 2), (2000, [0.0] * 8, 1),
             (2001, None, 1), (2002, [None] + [1.0] * 7, 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 1), (2005, [1.0], 1), (2006, [], 1)]
    check(spark, rows, 8)


def test_huge_components_stay_exact(spark):
    rows = table(300, 8, 4) + [(500, [1e30] + [0.0] * 7, 1), (501, [-1e30] * 8, 2), (502, [1e5] * 8, 1), (503, [-1e12, 3.0] * 4, None), (-1, [2e12] * 8, 0)]
    check(spark, rows, 8)


def test_small_and_empty(spark):
    check(spark, table(16, 8), 8)
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    same = codes.compress(spark.createDataFrame([(i, [0.5] * 4, None) for i in range(10)], SCHEMA)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in same} == {("00000000", 0, 0)}
    assert {r["code"] for r in codes.compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()} == {"00000000"}


def test_clashing_columns_and_no_label(spark):
    from pyspark.sql import functions as F
    rows = table(40, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", F.lit("x").alias("code"), F.lit(1).alias("error"), F.lit(1).alias("x"), F.lit(1).alias("_label"))
    assert sorted(map(repr, codes.compress(clash).collect())) == sorted(map(repr, codes.compress(df).collect()))
    assert len({r["label_error"] for r in codes.compress(df.drop("label")).collect()}) == 1


def test_candidates_hold_every_entry_in_the_radius():
    r = np.random.default_rng(1)
    for sd, n, w in ((40, 256, 4), (1000, 100, 16), (3, 65, 2), (500, 1, 5)):
        book = np.floor(r.normal(size=(n, w)) * sd).astype(np.int64)
        x = np.floor(r.normal(size=(700, w)) * sd).astype(np.int64)
        index = codes.SliceIndex(book)
        masks = np.unpackbits(index.candidates(x.astype(float)).view(np.uint8), axis=1, bitorder="little")
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        radius = index.radius(x.astype(float))
        assert (masks[:, :n] >= (d <= radius[:, None] ** 2)).all() and not masks[:, n:].any()
        i, e = index.nearest(x)
        assert (i == d.argmin(1)).all() and (e == d.min(1)).all()
    assert masks.any()


def test_masks_leave_few_of_spread_entries():
    """Entries spread over few dimensions: ranges leave a small part of them."""
    r = np.random.default_rng(2)
    book = np.floor(r.uniform(-5000, 5000, size=(256, 2))).astype(np.int64)
    masks = codes.SliceIndex(book).candidates(np.floor(r.uniform(-5000, 5000, size=(500, 2))))
    assert np.unpackbits(masks.view(np.uint8), axis=1).sum(1).mean() < 32
