"""The registered queries: their columns, their SQL, and plain versions of those
that SQL can't express, on the small tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import WORD, best_fit, held_out, near_components, shingles
from tokenizers import Tokenizer

from relflow.llm.queries import ORACLES, QUERIES
from relflow.plans.oracle import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    2: ["page_id", "host", "path", "rule", "verdict"], 4: ["doc_id", "n_shingles", "component_id", "kept"],
    5: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], 6: ["vec_id", "n_links", "component_id", "kept"],
    7: ["doc_id", "held_out", "score", "predicted"], 8: ["doc_id", "size", "source_size", "target", "taken"],
    9: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], 10: ["query_id", "rank", "vec_id", "score"]}
NAME = {int(n[2:].split("_")[0]): n for n in QUERIES}


def rows(spark, n):
    return QUERIES[NAME[n]](spark, SF).collect()


def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    assert QUERIES[NAME[n]](spark, SF).columns[:len(COLUMNS[n])] == COLUMNS[n]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    r = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert r["cols_match"] and r["values_match"] and not r["type_mismatches"], r


def test_near_duplicates(spark):
    texts = docs(spark)
    want = near_components(sorted(texts.items()))
    got = rows(spark, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in got)


def test_packing(spark):
    full, texts, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), docs(spark), {}
    out = rows(spark, 9)
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids = full.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(got.pop(i), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 1024 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not got
    fill = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(1024 - f for f in fill.values()) == best_fit([r["length"] for r in out], 1024)


def test_mix(spark):
    texts = docs(spark)
    out = rows(spark, 8)
    assert {r["doc_id"]: r["size"] for r in out} == {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert abs(sum(r["taken"] for r in out) - sum(r["size"] for r in out)) <= 20


def test_vectors(spark):
    data = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    links = {r["vec_id"]: r["n_links"] for r in rows(spark, 6)}
    want = (s >= 0.9).sum(axis=1)
    assert sum(links.values()) >= 0.9 * want.sum() and all(links[i] <= n for i, n in zip(ids, want))
    found = {}
    for r in rows(spark, 10):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    hits = sum(len(set(found[ids[q]]) & set(ids[np.argsort(-s[q], kind="stable")[:5]])) for q in asked)
    assert set(found) == set(ids[asked]) and hits >= 0.9 * 5 * len(asked)


def test_quality_and_toxicity(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in rows(spark, 1)}
    good = [kept[i] for i, r in labels.items() if r["quality"] == 1]
    assert np.mean(good) >= 0.95
    out = {r["doc_id"]: r for r in rows(spark, 7)}
    assert len(out) == len(kept) and all(r["held_out"] == held_out(i) for i, r in out.items())
    train = [(out[i]["predicted"], r["toxic"]) for i, r in labels.items() if not held_out(i)]
    assert np.mean([p == t for p, t in train]) >= 0.85


def test_base_spans_digest_of_nothing(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r["base_sha256"] == empty and r["spans"] == "" for r in rows(spark, 5))
