"""Vector code compression: product codes whose nearest entries are found by slicing
and intersecting bitmasks.

Components become integers ``floor(1024 * x)``; a vector is cut into equal consecutive
parts, each with a codebook of up to 256 integer entries, which Lloyd rounds move to
the floored means of their parts. All arithmetic is exact.

The index of a codebook holds, for every dimension, the entries' sorted coordinates and
a table of prefix masks (uint64 words, a bit for each entry): mask ``i`` marks the ``i``
entries of smallest coordinate. The distance to the best of a few seeds, entries next to
the part in the widest dimensions, is the initial radius. In each dimension two binary
searches turn the radius into a range of sorted coordinates, whose entries are the
difference of two prefix masks; the masks of all dimensions are ANDed. No entry within
the radius can be missing, so the nearest one, and on ties the lowest index, is found
by comparing exact distances of the entries left.

A round is one pass of the stored integer vectors: tasks assign their rows and add up
each entry's parts, so 256 sums per part and task are shuffled, and the sums of all
tasks (``parts x entries x width`` numbers, whatever the number of rows) make the
next codebooks. A lost executor repeats its tasks only.

Rows: null vectors and vectors with a null or non-finite component are dropped, also
those that have not the most common length (of equally common ones the largest).
Zero vectors and repeated ids stay, with a row for each input row. A null ``vec_id``
sorts after all ids; rows of one id are sorted by their vectors. Floors beyond the range
of a long are set to its limit. With fewer than 256 rows the codebooks are shorter.
A length that 4 does not divide is filled up with zeros. ``error`` and ``label_error``
are null beyond the range of a long. Null labels belong together; a table without the
label column counts as all null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.llm import common as C
from relflow.llm import vectors as V

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
SEEDS = 4               # widest dimensions that give two seeds each
_ROWS = 2048            # compared at once
_EXACT = float(1 << 53)     # doubles below it hold all integers


class SliceIndex:
    """Nearest entries of one codebook (entries x width longs)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.n, self.width = book.shape
        self.words = -(-self.n // 64)
        self.order = np.argsort(book, axis=0, kind="stable")
        self.coords = np.take_along_axis(book, self.order, 0).astype(np.float64)
        bits = np.zeros((self.n, self.words), np.uint64)
        at = np.arange(self.n)
        bits[at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        self.prefix = np.zeros((self.width, self.n + 1, self.words), np.uint64)
        for j in range(self.width):
            np.bitwise_or.accumulate(bits[self.order[:, j]], axis=0, out=self.prefix[j, 1:])
        # products of parts and entries up to this size add up exactly in doubles
        self.limit = int((_EXACT / (4 * max(self.width, 1))) ** 0.5)
        self.small = (np.abs(book.astype(np.float64)) <= self.limit).all(axis=1)
        self.values = np.where(self.small[:, None], book, 0).astype(np.float64)
        self.squares = (self.values ** 2).sum(axis=1)
        spread = self.coords[-1] - self.coords[0] if self.n else np.zeros(self.width)
        self.wide = np.argsort(-spread, kind="stable")[:SEEDS]

    def radius(self, x: np.ndarray) -> np.ndarray:
        """An upper bound of the distance to the nearest entry."""
        best = np.full(len(x), np.inf)
        for j in self.wide:
            i = np.searchsorted(self.coords[:, j], x[:, j])
            for step in (-1, 0):
                e = self.order[np.clip(i + step, 0, self.n - 1), j]
                best = np.minimum(best, ((x - self.book[e].astype(np.float64)) ** 2).sum(axis=1))
        return np.sqrt(best) * (1 + 1e-9) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries inside the radius in every dimension."""
        r = self.radius(x)
        mask = np.full((len(x), self.words), ~np.uint64(0))
        for j in range(self.width):
            lo = np.searchsorted(self.coords[:, j], x[:, j] - r, "left")
            hi = np.searchsorted(self.coords[:, j], x[:, j] + r, "right")
            mask &= self.prefix[j, hi] & ~self.prefix[j, lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of longs, and the squared distance:
        a double below 2^53, exact, or -1 where it is larger (see ``exact``)."""
        found, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.float64)
        for a in range(0, len(x), _ROWS):
            part = x[a:a + _ROWS]
            f = part.astype(np.float64)
            mask = self.candidates(f)
            bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :self.n].astype(bool)
            fits = (np.abs(f) <= self.limit).all(axis=1) & ~(bits & ~self.small).any(axis=1)
            i, d = self._compare(f, bits)
            for r in np.flatnonzero(~fits):
                i[r] = exact(part[r], self.book, np.flatnonzero(bits[r]))[0]
                d[r] = -1
            found[a:a + _ROWS], error[a:a + _ROWS] = i, d
        return found, error

    def _compare(self, x: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (x * x).sum(axis=1)
        if bits.mean() < 1 / 16:        # few candidates: each by itself
            row, entry = np.nonzero(bits)
            d = ((x[row] - self.values[entry]) ** 2).sum(axis=1)
            best = np.full(len(x), np.inf)
            np.minimum.at(best, row, d)
            first = np.full(len(x), self.n)
            hit = d == best[row]
            np.minimum.at(first, row[hit], entry[hit])
            return first, best
        d = np.where(bits, self.squares - 2 * (x @ self.values.T), np.inf)
        i = d.argmin(axis=1)
        return i, d[np.arange(len(x)), i] + own


def exact(x: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[int, int]:
    """Nearest entry by Python integers, for values of any size."""
    x = [int(v) for v in x]
    return min(((int(e), sum((p - int(q)) ** 2 for p, q in zip(x, book[e]))) for e in among), key=lambda t: (t[1], t[0]))


def _parts(x: np.ndarray, width: int) -> list[np.ndarray]:
    if x.shape[1] < PARTS * width:
        x = np.concatenate([x, np.zeros((len(x), PARTS * width - x.shape[1]), np.int64)], axis=1)
    return [np.ascontiguousarray(x[:, p * width:(p + 1) * width]) for p in range(PARTS)]


def _sums(books: list[np.ndarray], width: int):
    """Per task: each entry's rows, and the sums of their upper and lower 32 bits."""
    def run(batches):
        index = [SliceIndex(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        high = [np.zeros(b.shape, np.int64) for b in books]
        low = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(_parts(V.longs(batch.column(0)), width)):
                i, _ = index[p].nearest(x)
                n[p] += np.bincount(i, minlength=len(n[p]))
                np.add.at(high[p], i, x >> 32)
                np.add.at(low[p], i, x & 0xFFFFFFFF)
        for p in range(PARTS):
            e = np.repeat(np.flatnonzero(n[p]), width)
            d = np.tile(np.arange(width), len(e) // width if width else 0)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(e), p, np.int32), "entry": e.astype(np.int32), "dim": d.astype(np.int32),
                                              "n": n[p][e], "high": high[p][e, d], "low": low[p][e, d]})
    return run


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    sums = rows.select("x").mapInArrow(_sums(books, width), "part int, entry int, dim int, n long, high long, low long")
    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), *total).collect():
        out[r["part"]][r["entry"], r["dim"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return out


def _coded(books: list[np.ndarray], width: int):
    def run(batches):
        index = [SliceIndex(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(V.longs(batch.column(2)), width)
            found = [index[p].nearest(x[p]) for p in range(PARTS)]
            codes = np.stack([i for i, _ in found], axis=1)
            errors = np.stack([e for _, e in found], axis=1)
            sound = (errors >= 0).all(axis=1) & (errors.sum(axis=1) < _EXACT)
            total = [int(t) for t in np.where(sound, errors.sum(axis=1), 0)]
            for r in np.flatnonzero(~sound):
                t = sum(exact(x[p][r], books[p], [codes[r, p]])[1] for p in range(PARTS))
                total[r] = t if t < 1 << 63 else None
            hexed = codes.astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hexed[i:i + step] for i in range(0, len(hexed), step)], pa.string()),
                                              pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def first_entries(rows: DataFrame) -> np.ndarray:
    """The vectors of the smallest ids, at most ``ENTRIES``, in order."""
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), -1) if first else np.zeros((0, 0), np.int64)


def train(rows: DataFrame) -> tuple[list[np.ndarray], int]:
    """``(codebooks, width)`` of the integer vectors ``rows`` (vec_id, x)."""
    first = first_entries(rows)
    width = -(-first.shape[1] // PARTS) if len(first) else 0
    books = _parts(first, width)
    for _ in range(ROUNDS if width and len(first) else 0):
        books = _moved(rows, books, width)
    return books, width


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(table: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of ``table``
    (vec_id, embedding, label): a code of two hex digits per part for each row."""
    rows = C.stored(V.integer_vectors(table, SCALE))
    books, width = train(rows)
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = C.stored(rows.select("vec_id", "label", "x").mapInArrow(_coded(books, width), schema))
    # one row a label, of known size when stored: Spark broadcasts it only below its own limit
    sums = C.stored(coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.expr("try_sum(error)")).alias("label_error")))
    joined = coded.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
