"""The pipeline's stages against plain versions, each on its own input."""

import random
from collections import Counter

import public_tokenizers
from brute import DOCS, WORD, best_fit, near_components, redacted
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from relflow.llm import importance, mixing


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice(["ba", "lo", "mi", "ter", "en", "sa"]) for _ in range(r.randint(1, 3))) for _ in range(200)]
    rows, labels = [], []
    for i in range(260):
        t = [r.choice(words) for _ in range(r.randint(20, 90))]
        if i % 11 == 0:
            t.insert(3, "password=abcdefgh12345678")
        text = " ".join(t)
        if i % 13 == 5:
            text = rows[i - 3][1]
        if i % 13 == 6:
            w = rows[i - 4][1].split(" ")
            text = " ".join(w[:-1] + ["changed"])
        bad = i % 8 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, "en", None, None), (1001, "", "en", "s1", 0), (None, "a text without a name", None, "s2", 5), (7, rows[7][1], "en", "s3", 9)]
    return rows, labels


def keyed(rows):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/stage{i}")
        docs = spark.read.parquet(f"{sf}/stage{i}")
        seen.append(docs)
    quality, dedup, scan, mix, pack = [d.collect() for d in seen]

    # 1: clean rows stay as they are, bad ones go, but for the few that the sampling may draw
    bad = [r for r in rows if "!! " in (r[1] or "")]
    lost = Counter(rows) - keyed(quality)
    assert not keyed(quality) - Counter(rows)
    assert not lost - Counter(bad) and sum(lost.values()) >= len(bad) - 2
    sampler, scored = importance.sampler(spark.createDataFrame(rows, DOCS), spark.read.parquet(f"{sf}/labels.parquet"))
    assert scored.where(F.col("key") >= sampler.cut).count() == len(quality)

    # 2: one row of each group, and the row without a name
    comp = near_components([(r["doc_id"], r["text"]) for r in quality if r["doc_id"] is not None])
    assert sorted(r["doc_id"] for r in dedup if r["doc_id"] is not None) == sorted({c for c in comp.values()})
    assert sum(r["doc_id"] is None for r in dedup) == 1 and not keyed(dedup) - keyed(quality)

    # 3: secrets replaced, all else as it was
    want = Counter()
    for r in dedup:
        new = None if r["text"] is None else redacted(r["text"])
        want[(r["doc_id"], new, r["lang"], r["source"], r["n_chars"] if new == r["text"] else len(new))] += 1
    assert keyed(scan) == want and any("[assign]" in (r["text"] or "") for r in scan)

    # 4: each document as often as the mix takes it
    made = mixing.mix(spark.read.parquet(f"{sf}/stage2"), block_words=None)
    times = {(r["doc_id"], r["source"]): -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mixing.taken(made).collect()}
    assert keyed(mix) == Counter({k: n * times[(k[0], k[3])] for k, n in keyed(scan).items() if times[(k[0], k[3])]})
    total = sum(len(WORD.findall(r["text"] or "")) for r in scan)
    assert abs(sum(len(WORD.findall(r["text"])) for r in mix) - total) <= 4 * 91

    # 5: every row's tokens once, in as many sequences as best-fit decreasing needs
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter((r["doc_id"], tuple(full.encode(r["text"], add_special_tokens=False).ids + [2])) for r in mix)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pack) == tokens       # no text is longer than a sequence
    fills = {}
    for r in pack:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert sorted(1024 - f for f in fills.values()) == best_fit([len(t) for _, t in tokens.elements()], 1024)


def test_run_and_empty_documents(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() > 100
    none = f"{sf}/none"
    spark.createDataFrame([], DOCS).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert P.run(spark, none).count() == 0


def test_near_dedup_links_from_a_similarity_of_080(spark, tmp_path):
    rows = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(44 + i % 30)]
        rows.append((2 * i, " ".join(words), "en", "s", 0))
        words[20] = "changed"
        rows.append((2 * i + 1, " ".join(words), "en", "s", 0))
    want = set(near_components([(i, t) for i, t, *_ in rows], 80).values())
    assert len(set(near_components([(i, t) for i, t, *_ in rows]).values())) > len(want) > 40
    got = P.near_dedup(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
