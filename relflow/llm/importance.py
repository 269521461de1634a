"""Quality by importance resampling: hashed n-gram models of target and raw text,
sampled by Gumbel top-k.

Tokens are runs of letters, of digits or of the same punctuation character. A
text's features are its tokens, its pairs of neighbouring tokens, and its
triples of neighbouring token shapes (lower case, capitalised, upper case,
number, the punctuation itself, a repeat of the token before), hashed into
buckets. The raw model counts the features of all documents; the target model
those of labelled good documents, on top of a prior of the raw model's
proportions, so that a bucket with little target text says little. A document's
log weight is the sum of ``log(target / raw)`` over its features; it is kept in
fixed point, so the sum doesn't depend on the order.

Gumbel top-k: a document's key is its log weight plus Gumbel noise hashed from its
``doc_id``; the ``k`` largest keys are a sample without replacement in proportion to
the weights. ``k`` is the number of documents whose weight reaches the limit that
best separates labelled good from bad rows.

The target model and the limit are fitted on at most ``fit_rows`` labelled rows (a
documented bound; of rows that repeat a labelled ``doc_id`` the smallest text); counts,
weights, ``k`` and the selection cover all documents.

Rows: every row is weighed by itself. Null and empty texts have no features and
log weight 0. Rows with equal keys share their fate (repeated rows do), so a tie
at the limit can keep more than ``k``. Without good or bad labels every document is
kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.llm import common as C

U64 = C.U64
BUCKETS = 1 << 14           # for each of the three kinds of features
_POINT = 1 << 20            # fixed point of a log ratio
_SPACE, _LETTER, _DIGIT, _PUNCT = 0, 1, 2, 3

_CLASS = np.full(256, _PUNCT, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[C._IS_SPACE] = _SPACE


def features(data: np.ndarray, starts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of some texts given as bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _PUNCT) & (data[1:] != data[:-1]))
    new[starts[(starts > 0) & (starts < len(data))]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(data))
    solid = kind[s] != _SPACE
    s, e = s[solid], e[solid]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = C.span_hashes(data, s, e)
    doc = np.searchsorted(starts, s, "right") - 1
    upper = (data >= 65) & (data <= 90)
    first, last = upper[s], upper[e - 1] & (e - s > 1)
    shape = np.where(kind[s] == _LETTER, np.where(first & last, 3, np.where(first, 2, 1)), 4).astype(U64)
    punct = kind[s] == _PUNCT
    shape[punct] = 8 + data[s[punct]].astype(U64)
    same1 = np.zeros(len(s), bool)
    same1[1:] = doc[1:] == doc[:-1]
    repeat = same1.copy()
    repeat[1:] &= h[1:] == h[:-1]
    shape[repeat & ~punct] = 5
    out, docs = [C.mix(h + U64(1)) % U64(BUCKETS)], [doc]
    two = np.flatnonzero(same1)
    pair = np.where(repeat[two], U64(77), h[two - 1] * U64(3) + h[two])
    out.append(C.mix(pair + U64(2)) % U64(BUCKETS) + U64(BUCKETS))
    docs.append(doc[two])
    three = two[same1[two - 1] & (two > 1)]
    triple = (shape[three - 2] * U64(1 << 20)) + (shape[three - 1] * U64(1 << 10)) + shape[three]
    out.append(C.mix(triple + U64(3)) % U64(BUCKETS) + U64(2 * BUCKETS))
    docs.append(doc[three])
    return np.concatenate(out).astype(np.int64), np.concatenate(docs)


def _counts(batches):
    total = np.zeros(3 * BUCKETS, np.int64)
    for batch in batches:
        data, off = C.text_buffers(batch.column("text"))
        for a, b in C.doc_ranges(off):
            total += np.bincount(features(data[off[a]:off[b]], off[a:b] - off[a], b - a)[0], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def count_features(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over the texts of ``docs``: summed in each task, then
    by Spark; a fixed number of sums reaches the driver."""
    out = np.zeros(3 * BUCKETS)
    for r in docs.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray      # log ratio of each bucket, fixed point

    def log_weight(self, text: Column) -> Column:
        ratios = self.ratios

        def weigh(texts: pa.Array) -> pa.Array:
            data, off = C.text_buffers(texts)
            out = np.zeros(len(texts))
            for a, b in C.doc_ranges(off):
                f, doc = features(data[off[a]:off[b]], off[a:b] - off[a], b - a)
                sums = np.zeros(b - a, np.int64)
                np.add.at(sums, doc, ratios[f])
                out[a:b] = sums / _POINT
            return pa.array(out, pa.float64())

        return F.arrow_udf(weigh, "double")(text)


def fit(raw: np.ndarray, target: np.ndarray, prior: float = 4.0) -> Model:
    """Log ratios of the target model (with ``prior`` pseudo-counts a bucket in the
    raw model's proportions) to the raw model, for each kind of features."""
    out = []
    for i in range(3):
        r, t = raw[i * BUCKETS:(i + 1) * BUCKETS] + 0.5, target[i * BUCKETS:(i + 1) * BUCKETS]
        p = r / r.sum()
        q = (t + prior * BUCKETS * p) / (t.sum() + prior * BUCKETS)
        out.append(np.log(q / p))
    return Model(np.round(np.concatenate(out) * _POINT).astype(np.int64))


def separating_limit(good: np.ndarray, bad: np.ndarray, loss: float = 10.0) -> float:
    """The limit with the least cost of wrong decisions on labelled rows, where
    losing a good row costs ``loss`` times keeping a bad one; the middle of the gap."""
    x = np.concatenate([good, bad])
    order = np.argsort(x, kind="stable")
    x, is_good = x[order], np.concatenate([np.ones(len(good), bool), np.zeros(len(bad), bool)])[order]
    # limit before position i: good rows before i are lost, bad rows from i on are kept
    cost = np.concatenate([[0], np.cumsum(is_good)]) * loss / max(1, len(good)) + (len(bad) - np.concatenate([[0], np.cumsum(~is_good)])) / max(1, len(bad))
    i = int(np.argmin(cost))
    if i == 0:
        return -np.inf
    return float((x[i - 1] + x[min(i, len(x) - 1)]) / 2)


@dataclass(frozen=True)
class Sampler:
    model: Model
    cut: float
    seed: int

    def log_weight(self, docs: DataFrame) -> Column:
        return self.model.log_weight(docs["text"])

    def noise(self, docs: DataFrame) -> Column:
        return -F.log(-F.log(C.hash_unit(self.seed, docs["doc_id"].cast("long"))))

    def kept_documents(self, docs: DataFrame) -> DataFrame:
        """The documents of the sample, all their columns as they are."""
        return docs.where(self.log_weight(docs) + self.noise(docs) >= F.lit(self.cut))


def sampler(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, prior: float = 4.0, seed: int = 23) -> tuple[Sampler, DataFrame]:
    """A sampler for ``docs`` (doc_id, text), with ``labels`` (doc_id, quality 0 or
    1), and the stored table ``(doc_id, log_weight, key)`` it was made with."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = C.stored(seen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows))
    # one row a label, whatever repeats its doc_id: at most ``fit_rows`` rows
    fitted = C.stored(docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    raw = count_features(docs)
    target = count_features(fitted.where("quality = 1"))
    model = fit(raw, target, prior)
    plain = Sampler(model, -np.inf, seed)
    w = plain.log_weight(docs)
    scored = C.stored(docs.withColumn("log_weight", w).withColumn("key", F.col("log_weight") + plain.noise(docs)).select("doc_id", "log_weight", "key"))
    rows = fitted.select("quality", plain.log_weight(fitted).alias("log_weight")).toPandas()
    good, bad = (rows.loc[rows["quality"] == q, "log_weight"].to_numpy() for q in (1, 0))
    cut = -np.inf
    if len(good) and len(bad):
        limit = separating_limit(good, bad)
        k = scored.where(F.col("log_weight") >= F.lit(limit)).count()
        found = C.kth_largest(scored, "key", k)
        cut = np.inf if found is None else found
    return Sampler(model, float(cut), seed), scored


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, log_weight, key, kept)`` for every row of ``docs``."""
    made, scored = sampler(docs, labels, **options)
    return scored.withColumn("kept", F.col("key") >= F.lit(made.cut))
