import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import DOCS, best_fit
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=120))))
def test_runs_equal_piece_by_piece_packing(case):
    size, lengths = case
    fill, seen = Counter(), {}
    for n, _, pieces, k, first, offset in packing.best_fit_decreasing(Counter(lengths), size):
        for i in range(pieces):
            seen.setdefault(first + i // k, []).append((offset + i % k * n, n))
    for s, spans in seen.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        fill[s] = at
    assert sorted(size - f for f in fill.values()) == best_fit(lengths, size)
    assert sum(map(len, seen.values())) == len(lengths)


def test_ids_equal_the_tokenizer():
    ids, full, r = packing._ids(PATH), Tokenizer.from_file(PATH), random.Random(2)
    alphabet = [chr(i) for i in range(256)] + ["<|endoftext|>", "œ", "漢", "😀", " ", "a" * 40, "  ", "́"]
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert list(ids(t)) == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_very_long_text_is_cut_where_ids_do_not_change():
    ids, r = packing._ids(PATH), random.Random(3)
    words = ["alpha", "Béta", "x1", "--", "\n", "  gap", "tail."]
    text = " ".join(r.choice(words) for _ in range(40_000))
    part = packing.Ids(PATH)
    part._PART = 1 << 12
    assert (part(text) == ids._one(text)).all()


@pytest.mark.parametrize("size", [16, 1024])
def test_pieces_and_round_trip(spark, size):
    texts = [None, "", "hello world", "hello world", "word " * 3000, "<|endoftext|> is a token", "Ünïcode 漢字 text", "a"]
    rows = [(i if i != 7 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(2, "hello world", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "offset").withColumnRenamed("lang", "piece")
    out = packing.pack_documents(df, PATH, size=size).collect()
    full, got = Tokenizer.from_file(PATH), {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= size
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for i, t, *_ in rows[:-1]:
        want = full.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(got[i])
        if i == 2:
            assert len(pieces) == 2 * len({p for p, _, _ in pieces})     # the repeated row is packed twice
            pieces = sorted({(p, s, tuple(x)) for p, s, x in pieces})
        assert [x for _, _, ids in pieces for x in ids] == want
        assert all(len(ids) == size for _, _, ids in pieces[1:])
    fills = {}
    for r in out:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fills.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
    assert sorted(size - sum(n for _, n in s) for s in fills.values()) == best_fit([r["length"] for r in out], size)


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7), "en", "s", 0) for i in range(50)], DOCS)
    packed = packing.pack_documents(df, PATH, size=32)
    by = {(r["doc_id"], r["piece"]): r["ids"] for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) <= 32
        for s in r["spans"]:
            assert r["ids"][s["offset"]:s["offset"] + s["length"]] == by[s["doc_id"], s["piece"]]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
