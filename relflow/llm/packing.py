"""Best-fit decreasing packing of tokenised documents into sequences.

A document's tokens are its ids from a public byte-level BPE vocabulary followed
by an end id. A document longer than a sequence is cut into full pieces, of
which the first may be shorter; every piece goes whole into one sequence.

Best-fit decreasing takes pieces from long to short and puts each into the open
sequence with the least room that still holds it. Only lengths matter, and
there are at most ``size`` of them, so the packing itself runs on the histogram
of lengths: open sequences are counted by remaining room, a segment tree over
the rooms 0..size finds the tightest one in logarithmic time, and equal steps
(the same length into sequences with the same room) are taken together. The
plan is a list of runs, whose number depends on ``size`` and not on the number of
documents. A piece finds its place from its length and its rank among the
pieces of that length; ranks come from hash buckets of bounded size and the
buckets' totals, so that a length with a third of all pieces spreads over tasks.

Rows: a null text is an empty one (its only token is the end id). Repeated rows
are packed as often as they occur. A null ``doc_id`` stays null. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.llm import common as C

END = 2
SIZE = 1024
_LOADED: dict = {}


class Ids:
    """The ids that ``tokenizers`` gives for the vocabulary at ``path``.

    Texts of Latin-1 characters without the opening of a special token go
    through ``tiktoken`` with the same vocabulary and merge order, which gives
    the same ids in a quarter of the time; all others through ``tokenizers``."""

    _CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
    _PART = 1 << 20

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest is shifted to U+0100..
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and not t.startswith("<|")}
        import public_tokenizers
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)

    def _one(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        ids = self.fast.encode_ordinary(text) if plain else self.full.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= 2 * self._PART:
            return self._one(text)
        out, at = [], 0     # a blank between two letters always starts a new pre-token
        while at < len(text):
            m = self._CUT.search(text, at + self._PART)
            end = m.start() if m else len(text)
            out.append(self._one(text[at:end]))
            at = end
        return np.concatenate(out)


def _ids(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def _pieces(batches, path: str, size: int, end: int, with_ids: bool):
    """Pieces of each text: start, length, checksum and, if asked for, ids."""
    encode = _ids(path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def flush(doc, rows, ids):
        cols = [doc.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32())]
        cols += [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]
        if with_ids:
            cols.append(C.list_array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32),
                                     np.array([r[3] for r in rows], np.int64), pa.int32()))
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        doc, rows, ids, held = batch.column("doc_id"), [], [], 0
        for i, text in enumerate(batch.column("text")):
            tok = np.append(encode(text.as_py() or ""), np.uint32(end))
            first = len(tok) % size or size
            at, piece = 0, 0
            while at < len(tok):
                n = first if piece == 0 else size
                part = tok[at:at + n]
                rows.append((i, piece, at, n, zlib.crc32(part.astype("<u4").tobytes())))
                if with_ids:
                    ids.append(part)
                at, piece, held = at + n, piece + 1, held + n
            if held > 1 << 20:
                yield flush(doc, rows, ids)
                rows, ids, held = [], [], 0
        if rows:
            yield flush(doc, rows, ids)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's tokens cut
    into pieces of at most ``size``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda it: _pieces(it, tokenizer, size, end, with_ids), schema)


class Rooms:
    """Segment tree over the rooms 0..size: how many open sequences have each,
    and the least room of at least a given length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1:        # up to the first right-hand neighbour with an open sequence, then down
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, pieces a sequence, first sequence,
    offset)`` of best-fit decreasing over ``histogram`` (length -> pieces). Piece
    ``i`` of a run goes to sequence ``first + i // k`` at ``offset + i % k * length``."""
    rooms, open_ = Rooms(size), [deque() for _ in range(size + 1)]
    runs, n_seq = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.add(room, n)
            open_[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, k = size, size // length
                first, have = n_seq, -(-left // k)
                n_seq += have
            else:
                first, have = open_[room].popleft()
                rooms.add(room, -have)
                k = room // length      # a sequence stays the tightest until it holds no more
            n = min(left, have * k)
            runs.append((length, rank, n, k, first, size - room))
            whole, over = divmod(n, k)
            put(room - k * length, first, whole)
            if over:
                put(room - over * length, first + whole, 1)
            used = whole + (over > 0)
            put(room, first + used, have - used)
            rank, left = rank + n, left - n
    return runs


def pack(pieces: DataFrame, size: int = SIZE, bucket_rows: int = 1_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with ``sequence_id`` and ``offset``.
    They are read several times: pass a stored table."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    runs = best_fit_decreasing(hist, size)
    # each length has buckets of about ``bucket_rows`` pieces; at most ``size`` rows are broadcast
    buckets = pieces.sparkSession.createDataFrame([(n, -(-c // bucket_rows)) for n, c in hist.items()], "length long, buckets long")
    h = F.xxhash64(F.lit(3), "doc_id", "piece", "ids_crc32")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(h, "buckets")).drop("buckets")
    totals = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (dealt.withColumn("rank", rank - 1).join(totals, ["length", "bucket"])
              .withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).select(*pieces.columns, "rank"))
    # each length's runs, at most a few: the one that holds the rank gives the place
    by: dict[int, list] = {}
    for n, *run in runs:
        by.setdefault(n, []).append(tuple(run))
    kind = "array<struct<rank long, pieces long, k long, seq long, at long>>"
    places = F.broadcast(pieces.sparkSession.createDataFrame(list(by.items()), f"length long, runs {kind}"))
    run = F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("rank")) & (F.col("rank") < r["rank"] + r["pieces"])), 1)
    out = ranked.join(places, "length").withColumn("run", run).withColumn("i", F.col("rank") - F.col("run.rank"))
    return out.select(*pieces.columns, (F.col("run.seq") + F.expr("i div run.k")).alias("sequence_id"),
                      (F.col("run.at") + F.col("i") % F.col("run.k") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``(sequence_id, ids, spans)``, spans naming the
    document piece at each offset. ``packed`` needs ``ids``; at most ``size``
    tokens meet in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"),
                                            x["piece"].alias("piece"), x["length"].alias("length"))).alias("spans"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """Documents tokenised once, stored, and packed."""
    return pack(C.stored(token_pieces(docs, tokenizer, size, end, with_ids)), size)
