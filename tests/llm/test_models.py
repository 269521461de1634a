import math
import random

import numpy as np
from brute import DOCS, held_out
from pyspark.sql import functions as F

from relflow.llm import importance, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    stems = ["ba", "lo", "mi", "ter", "en", "sa", "ko"]
    words = ["".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(30, 120))]
        bad, toxic = i % 7 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                t[r.randrange(len(t))] = "grumf" + r.choice(["et", "oso", "alle", "ing"])
        text = " ".join(w.capitalize() if k % 9 == 0 else w for k, w in enumerate(t)) + "."
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", 0))
        if i % 10 != 9:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


EDGE = [(None, "Plain text"), (5000, None), (5001, ""), (5002, " \n"), (5003, "z" * 300000), (5004, "word " * 60000), (1, "again"), (5005, "漢字 😀")]


def frames(spark):
    docs, labels = corpus()
    docs += [(i, t, "en", "s", 0) for i, t in EDGE]
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("lang", "score").withColumnRenamed("source", "key")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (4, None, None), (7, 9, 9), (1, 1, 1), (99999, 0, 1)], LABELS)
    return docs, labels, df, lab


def test_resampling_keeps_good_and_drops_bad(spark):
    docs, labels, df, lab = frames(spark)
    fit = lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = importance.resample(df, fit).collect()
    assert len(out) == len(docs)
    kept = {r["doc_id"]: r["kept"] for r in out if r["doc_id"] is not None}
    held = [(i, q) for i, q, _ in labels if held_out(i) and i != 1]
    assert all(kept[i] == bool(q) for i, q in held) and {q for _, q in held} == {0, 1}
    weight = {r["doc_id"]: r["log_weight"] for r in out}
    assert weight[5000] == weight[5001] == weight[5002] == 0
    sampler, scored = importance.sampler(df, fit)
    assert sampler.kept_documents(df).count() == sum(r["kept"] for r in out)
    assert sampler.kept_documents(df).columns == df.columns
    # the key is the weight plus noise, and the cut is the k-th largest key
    keys = sorted((r["key"] for r in out if r["key"] is not None), reverse=True)
    assert sampler.cut in keys


def test_features_do_not_depend_on_neighbours_and_sum_like_a_plain_count(spark):
    texts = ["The cat -- the Cat!! sat 12 12 x", "", "é Été ÉTÉ", "A a A a"]
    def count(ts):
        data = np.frombuffer("".join(ts).encode(), np.uint8)
        off = np.cumsum([0] + [len(t.encode()) for t in ts])
        f, d = importance.features(data, off[:-1], len(ts))
        return [sorted(f[d == i]) for i in range(len(ts))]
    assert count(texts) == [count([t])[0] for t in texts]
    n = len("The cat -- the Cat !! sat 12 12 x".split())
    assert len(count(texts[:1])[0]) == n + n - 1 + n - 2
    df = spark.createDataFrame([(t,) for t in texts + [None]], "text string").repartition(3)
    total = np.bincount(np.concatenate(count(texts)).astype(np.int64), minlength=3 * importance.BUCKETS)
    assert (importance.count_features(df) == total).all()


def test_gumbel_top_k_draws_in_proportion_to_the_weights(spark):
    w = np.array([8.0, 4.0, 2.0, 1.0, 1.0])
    hits = np.zeros(5)
    df = spark.range(5).withColumnRenamed("id", "doc_id").withColumn("text", F.lit(None).cast("string"))
    for seed in range(150):
        s = importance.Sampler(importance.Model(np.zeros(3 * importance.BUCKETS, np.int64)), 0.0, seed)
        g = np.array([r[0] for r in df.orderBy("doc_id").select(s.noise(df)).collect()])
        hits[np.argmax(np.log(w) + g)] += 1
    assert abs(hits[0] / 150 - 0.5) < 0.13 and abs(hits[1] / 150 - 0.25) < 0.11


def test_without_labels_all_stay_and_empty_table(spark):
    _, _, df, lab = frames(spark)
    assert all(r["kept"] for r in importance.resample(df, lab.limit(0)).collect())
    assert importance.resample(df.limit(0), lab).count() == 0


def test_kth_largest(spark):
    from relflow.llm.common import kth_largest
    r = random.Random(0)
    xs = [r.gauss(0, 1) for _ in range(3000)] + [0.5] * 500 + [1e300, -1e-300, 0.0, math.pi]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    s = sorted(xs, reverse=True)
    for k in (1, 2, 700, 1000, len(xs)):
        assert kth_largest(df, "x", k) == s[k - 1]
    assert kth_largest(df, "x", len(xs) + 1) is None


def test_toxicity_on_held_out_rows(spark):
    docs, labels, df, lab = frames(spark)
    out = toxicity.scores(df, lab).collect()
    assert len(out) == len(docs)
    by = {r["doc_id"]: r for r in out}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and held_out(r["doc_id"]))
    held = [(i, t) for i, _, t in labels if held_out(i) and i != 1]
    assert sum(by[i]["predicted"] == t for i, t in held) >= 0.95 * len(held)
    assert by[5000]["score"] == by[5001]["score"] == by[5002]["score"] < 0.5


def test_labels_of_held_out_rows_are_not_read(spark):
    _, labels, df, lab = frames(spark)
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["score"], str(r["doc_id"])) for r in toxicity.scores(df, x).collect()) for x in (lab, flipped))
    assert a == b


def test_label_model_finds_accuracies_and_correlations(spark):
    r = np.random.default_rng(0)
    n = 20000
    y = r.random(n) < 0.2
    rate = np.array([[0.01, 0.02, 0.01, 0.05, 0.05], [0.6, 0.5, 0.4, 0.06, 0.3]])
    v = r.random((n, 5)) < rate[y.astype(int)]
    v[:, 4] = np.where(r.random(n) < 0.9, v[:, 0], v[:, 4])     # a near copy of the first voter
    bits = (v * (1 << np.arange(5))).sum(axis=1)
    df = spark.createDataFrame([(int(b), int(y[i]) if i % 10 == 0 else -1, 1) for i, b in enumerate(bits)], "votes long, label int, n long")
    start = np.tile(np.array([[0.02], [0.3]]), (1, 5))
    m = toxicity.label_model(df, 5, 0.15, start, rounds=8)
    assert abs(m.rates[1, 1] - 0.5) < 0.12 and abs(m.rates[0, 1] - 0.02) < 0.02
    assert m.correlations[0, 4] > 0.4 and abs(m.correlations[1, 2]) < 0.2
    assert m.weights[0][4] < np.log(m.rates[1, 4] / m.rates[0, 4]) * 0.75
    assert abs(m.weights[0][3]) < abs(m.weights[0][1])


def test_toxicity_without_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "you idiot, such trash"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(df, lab).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.scores(df.limit(0), lab).count() == 0


def test_words_of_unlabelled_documents_are_learned_from_posteriors(spark):
    docs, _, _, lab = frames(spark)
    r, plain = random.Random(3), docs[2][1]

    def abuse(text):        # five words of the lexicon
        return " ".join([text, *r.sample(toxicity.SEEDS, 5)])

    docs = [(i, abuse(docs[2 + i % 3][1]) if i is not None and i < 600 and i % 5 == 1 else t, *rest) for i, t, *rest in docs]
    docs = [(i, None if t is None else t.replace("grumf", "ba"), *rest) for i, t, *rest in docs]
    docs += [(7000 + i, abuse(plain) + " vexilor", "en", "s", 0) for i in range(60)]
    docs += [(8000, f"{plain} vexilor", "en", "s", 0), (8001, f"{plain} other", "en", "s", 0)]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(spark.createDataFrame(docs, DOCS).repartition(5), lab).where("doc_id >= 7000").collect()}
    assert all(got[7000 + i] >= 0.5 for i in range(60))
    assert got[8000] > 3 * got[8001] and got[8001] < 0.5, (got[8000], got[8001])


def test_a_label_is_a_voter_with_rates_of_its_own():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.3
    label = np.where(r.random(20000) < 0.9, y, ~y).astype(int)
    post = np.clip(np.where(y, 0.95, 0.05), 0, 1)
    clean, toxic = toxicity.label_rates(post, label)
    assert abs(clean - 0.1) < 0.1 and abs(toxic - 0.9) < 0.1
    q = toxicity.with_label(np.array([0.5, 0.5, 0.5, 0.02] + [0.9] * 50 + [0.1] * 50), np.array([1, 0, -1, 1] + [1] * 50 + [0] * 50))
    assert q[0] > 0.8 and q[1] < 0.2 and q[2] == 0.5 and 0.02 < q[3] < q[0]


def test_a_repeated_labelled_id_counts_once(spark):
    docs = [(1, f"fine text {i}", "en", "s", 0) for i in range(3000)] + [(2, "bad idiot", "en", "s", 0), (3, "a good day", "en", "s", 0)]
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], LABELS)
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    assert importance.resample(df, lab, fit_rows=3).count() == len(docs)
    assert toxicity.scores(df, lab, fit_rows=3).where("doc_id = 2 AND predicted = 1").count() == 1
