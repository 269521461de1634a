import random

import numpy as np
import pytest
from brute import DOCS, near_components, shingles

from relflow.llm import common, minhash


def family(n, words, seed):
    """Texts around one text, with a few to many words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def run(spark, rows, **opt):
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "k1")
    return minhash.near_duplicates(df, **opt).collect()


def test_families_equal_brute_force_with_small_blocks(spark):
    texts = family(60, 60, 1) + family(40, 120, 2) + family(30, 40, 3)
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    want = near_components(rows)
    got = run(spark, rows, block=16)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("span", [1, 2, 3])
def test_a_long_bucket_is_dealt_to_cells_without_losing_a_link(spark, span):
    # a template's many texts share buckets; few of them are links, and those lie in any two blocks
    r = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        t = list(base)
        for at in r.sample(range(90), 4):
            t[at] = f"own{i}_{at}"
        rows.append((i, " ".join(t)))
        if i % 5 == 0:
            t[89] = f"twin{i}"
            rows.append((1000 - i, " ".join(t)))
    want = near_components(rows)
    assert len(set(want.values())) > 60
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)
    got = minhash.near_duplicates(df, bands=32, rows=2, block=8, span=span).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"),
            (9, "a b c d e"), (10, "z " * 3000), (11, "z " * 4000), (12, "long" * 100000), (12, "long" * 100000), (None, "a b c d e"), (13, "A B C D E")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12, 13: 9, None: None}
    assert {r["doc_id"]: r["n_shingles"] for r in got}[10] == 1
    assert [r["kept"] for r in got if r["doc_id"] is None] == [False]


def test_repeated_ids_join_their_texts(spark):
    a, b = family(1, 30, 7)[0], family(1, 30, 8)[0]
    got = run(spark, [(5, a), (5, b), (7, a), (9, b)])
    assert {r["component_id"] for r in got} == {5}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_distinct_documents_keep_one_of_each_group(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "other text"), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = minhash.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_distinct_documents_tell_rows_apart_whatever_their_ids(spark):
    texts = [f"text number {i} has its own words a{i} b{i} c{i} d{i}" for i in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (9, texts[1]), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, {"a": 1}, 1) for i, t in rows], "doc_id long, text string, extra map<string,int>, __file int").repartition(3)
    out = minhash.distinct_documents(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted([(5, texts[0]), (5, texts[1]), (0, texts[2]), (0, texts[3]), (4, ""), (4, "")])


def test_long_text_is_hashed_like_short_ones():
    words = [f"Word{i}" for i in range(400_000)]
    text = " ".join(words).encode()
    x = np.frombuffer(text, np.uint8)
    whole, _ = common.word_hashes(x, np.array([0, len(x)]))
    assert len(x) > 4 * common._CHUNK and len(whole) == len(words)
    few = " ".join(words[-1000:]).lower().encode()
    part, _ = common.word_hashes(np.frombuffer(few, np.uint8), np.array([0, len(few)]))
    assert (whole[-1000:] == part).all()


def test_superminhash_estimates_similarity_and_stops_early_without_change():
    r = np.random.default_rng(0)
    errs = []
    for _ in range(200):
        pool = r.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = pool[:300], pool[60:]
        sig = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 64)
        errs.append((sig[0] == sig[1]).mean() - 240 / 400)
    assert abs(np.mean(errs)) < 0.02 and np.std(errs) < 0.062     # plain MinHash: 0.061
    # one text at a time gives the same signature as all together, in any order
    assert (minhash.superminhash(b[::-1].copy(), np.zeros(len(b), np.int64), 1, 64)[0] == sig[1]).all()
    single = minhash.superminhash(np.array([5], np.uint64), np.zeros(1, np.int64), 1, 64)[0]
    assert sorted(single >> np.uint64(32)) == list(range(64))      # one element fills each place in its own step


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)], [(5, 5)]])
def test_components(spark, edges):
    from brute import Sets
    uf = Sets()
    for a, b in edges:
        uf.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in common.components(df, "a", "b").collect()}
    assert got == {n: uf.find(n) for n in uf.up if uf.find(n) != n}
