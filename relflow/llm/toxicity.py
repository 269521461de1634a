"""Toxicity by weak supervision: many lexicon and pattern voters, a generative
label model of their accuracies and correlations, and a linear classifier trained
on its posterior labels.

Patterns are whole words and the beginnings of words (of 4 to 7 bytes),
lower-cased, found by hash. A document has a pattern or not; how often doesn't
matter.

Voters: the seed lexicon's words, and patterns mined from labelled rows - those
far more common in toxic rows. Every voter groups some patterns of one kind and
strength and speaks where the document has one of them.

Label model: the votes of all documents, by expectation-maximisation. A
document's state is toxic or clean; each voter has a rate of speaking in either
state, and each two voters a correlation within the states. Speech and silence
both tell. Correlated voters share their weight: a voter's log odds count
``1 / (1 + sum of its correlations)``.
Labelled training rows enter with their label, all others with the posterior.

Classifier: logistic regression on posterior labels, trained on the labelled rows and
on as many documents without a label, drawn by hash of ``doc_id``. A given label is one
more voter, whose rates in either state are estimated against the other voters. The
patterns it weighs are mined from the posterior labels, so words that only stand in
unlabelled documents beside what the voters know are learned too. Its score reads the
text alone.

Bounds: mining and training use at most ``fit_rows`` labelled rows and ``fit_rows``
others (of rows that repeat a ``doc_id`` the smallest text). Votes and the label model
cover all documents.

Rows: one per input row, repeated ones too. Null and empty texts have no pattern
and get the score of a text without one. A label that is null or neither 0 nor 1
counts as none; rows with several labels count as toxic if one is. Without toxic
training rows only the seed lexicon speaks. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.llm import common as C
from relflow.llm.importance import separating_limit

U64 = C.U64
HEADS = (4, 5, 6, 7)        # bytes of a word's beginning
SEEDS = ("idiot", "stupid", "moron", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def patterns(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern hash, document) of every word and word beginning, with repeats."""
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(starts, s, "right") - 1
    hs, ds = [C.span_hashes(data, s, e, True)], [doc]
    for n in HEADS:
        long = e - s > n
        hs.append(C.mix(C.span_hashes(data, s[long], s[long] + n, True) + U64(n)))
        ds.append(doc[long])
    return np.concatenate(hs), np.concatenate(ds)


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(C.span_hashes(b, np.array([0]), np.array([len(b)]), True)[0])


class Lookup:
    """Finds a fixed set of pattern hashes among many."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> U64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, document) of every hit, once a document."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(h >> U64(44)).astype(np.int64)])
        h, doc = h[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        hit = self.sorted[at] == h
        both = np.unique(doc[hit].astype(np.int64) * len(self.sorted) + self.order[at[hit]])
        return both % len(self.sorted), both // len(self.sorted)


def _ranges(texts: pa.Array):
    data, off = C.text_buffers(texts)
    for a, b in C.doc_ranges(off):
        h, doc = patterns(data[off[a]:off[b]], off[a:b] - off[a]) if off[b] > off[a] else (np.zeros(0, U64), np.zeros(0, np.int64))
        yield a, b, h, doc


def _mined(batches):
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, h, doc in _ranges(batch.column("text")):
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, t = h[once], toxic[a + doc[once]]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            if len(at):
                n, t = np.diff(np.append(at, len(h))), np.add.reduceat(t, at)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "n1", "n0"])


def mine(rows: DataFrame, least: int, top: int) -> list[tuple[int, int, int]]:
    """The ``top`` patterns that tell most about ``toxic`` (text, toxic), as
    ``(hash, toxic rows, clean rows)``, each in at least ``least`` rows."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    seen = (rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(_mined, "h long, n1 long, n0 long")
            .groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= least))
    p1, p0 = (F.col("n1") + 0.5) / (n[1] + 1.0), (F.col("n0") + 0.5) / (n[0] + 1.0)
    odds = F.log(p1 / p0)
    worth = F.when(odds > 0, odds * (F.col("n1") / n[1] + 5.0 / n[1])).otherwise(0.0)       # what is told, times how often
    best = seen.withColumn("worth", worth).where((F.col("worth") > 0) & (odds > 1.5)).orderBy(F.desc("worth"), "h").limit(top).collect()
    return [(r["h"], r["n1"], r["n0"]) for r in best]


@dataclass(frozen=True)
class Voters:
    hashes: np.ndarray      # pattern hashes
    voter: np.ndarray       # the voter of each
    n: int

    def votes(self, text: Column) -> Column:
        """A bit for each voter."""
        hashes, voter = self.hashes, self.voter
        made: list[Lookup] = []

        def vote(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(Lookup(hashes))
            out = np.zeros(len(texts), np.int64)
            for a, b, h, doc in _ranges(texts):
                which, d = made[0].find(h, doc)
                np.bitwise_or.at(out, a + d, np.int64(1) << voter[which])
            return pa.array(out)

        return F.arrow_udf(vote, "long")(text)


def voters(mined: list[tuple[int, int, int]], seeds: tuple[str, ...], n: int = 40) -> Voters:
    """``n`` voters of mined patterns, dealt by strength in turn, and a voter for
    each two seed words."""
    seed = [word_hash(w) for w in seeds]
    hashes, of = list(seed), [i // 2 for i in range(len(seed))]
    first = (len(seed) + 1) // 2
    known = set(seed)
    pats = [m for m in mined if m[0] & (1 << 64) - 1 not in known]
    for i, (h, _, _) in enumerate(pats):
        hashes.append(h & (1 << 64) - 1)
        of.append(first + i % n)
    return Voters(np.array(hashes, U64), np.array(of, np.int64), first + min(n, len(pats)))


def _bits(votes: np.ndarray, n: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(n) & 1).astype(np.float64)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    rates: np.ndarray           # P(voter speaks | clean), P(... | toxic)
    correlations: np.ndarray    # within the states

    @property
    def weights(self) -> tuple[np.ndarray, float]:
        """What each voter's speech adds to the log odds, and the log odds of silence."""
        share = 1 / (1 + np.maximum(self.correlations, 0).sum(axis=1))
        speech = np.log(self.rates[1] / self.rates[0]) * share
        silence = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * share
        return speech - silence, float(np.log(self.prior / (1 - self.prior)) + silence.sum())

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        w, b = self.weights
        return 1 / (1 + np.exp(-np.clip(b + _bits(votes, self.rates.shape[1]) @ w, -50, 50)))


def _moments(frames, model: LabelModel, trust: float):
    """Sums over a task's rows, for each state: rows, votes and pairs of votes."""
    k = model.rates.shape[1]
    sums = np.zeros((2, 1 + k + k * k))
    for pdf in frames:
        votes, label, n = pdf["votes"].to_numpy(), pdf["label"].to_numpy(), pdf["n"].to_numpy().astype(float)
        q = np.where(label < 0, model.posterior(votes), np.where(label == 1, trust, 1 - trust))
        v = _bits(votes, k)
        for y, w in ((0, (1 - q) * n), (1, q * n)):
            sums[y] += np.concatenate([[w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()])
    at = np.flatnonzero(sums.ravel())
    yield pd.DataFrame({"i": at, "x": sums.ravel()[at]})


def label_model(votes: DataFrame, k: int, prior: float, start: np.ndarray, rounds: int = 5, trust: float = 0.97) -> LabelModel:
    """Expectation-maximisation over ``votes`` (votes, label or -1, n). ``start``:
    rates to begin with."""
    model = LabelModel(prior, start, np.zeros((k, k)))
    for _ in range(rounds):
        now = model
        sums = np.zeros(2 * (1 + k + k * k))
        rows = votes.mapInPandas(lambda it: _moments(it, now, trust), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        for r in rows:
            sums[r["i"]] = r["x"]
        sums = sums.reshape(2, -1)
        n = np.maximum(sums[:, 0], 1e-9)
        rate = (sums[:, 1:1 + k] + 0.5) / (n[:, None] + 1)
        cov = np.zeros((k, k))
        for y in (0, 1):
            cov += sums[y, 1 + k:].reshape(k, k) - np.outer(sums[y, 1:1 + k], sums[y, 1:1 + k]) / n[y]
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        corr[np.abs(corr) < 0.05] = 0
        model = LabelModel(float(np.clip(sums[1, 0] / max(sums[:, 0].sum(), 1), 1e-4, 1 - 1e-4)), rate, corr)
    return model


@dataclass(frozen=True)
class Classifier:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        hashes, weights, bias = self.hashes, self.weights, self.bias
        made: list[Lookup] = []

        def score(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(Lookup(hashes))
            z = np.full(len(texts), bias)
            for a, b, h, doc in _ranges(texts):
                which, d = made[0].find(h, doc)
                z[a:b] += np.bincount(d, weights[which], minlength=b - a)
            return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return F.arrow_udf(score, "double")(text)


def _hits(batches, hashes: np.ndarray):
    look = Lookup(hashes)
    for batch in batches:
        for a, b, h, doc in _ranges(batch.column("text")):
            which, d = look.find(h, doc)
            n = np.bincount(d, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("q").slice(a, b - a), batch.column("label").slice(a, b - a),
                                              C.list_array(which, n, pa.int64())], ["q", "label", "hits"])


def logistic(rows: list[np.ndarray], q: np.ndarray, n: int, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features with soft labels ``q``."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    w, b = np.zeros(n), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    df = np.bincount(feat, minlength=n).astype(float)
    sizes = np.maximum(1, np.bincount(doc, minlength=len(rows)))
    width = np.bincount(feat, sizes[doc].astype(float), minlength=n) / np.maximum(df, 1)
    for _ in range(rounds):     # each feature's step is bounded by its own curvature
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[feat], minlength=len(rows)), -50, 50)))
        g = np.bincount(feat, (q - p)[doc], minlength=n) - l2 * w
        w = w + g / (0.25 * df * np.maximum(width, 1) + l2)
        b += (q - p).sum() / (0.25 * len(rows) + 1)
    return w, b


def label_rates(post: np.ndarray, label: np.ndarray) -> np.ndarray:
    """P(labelled toxic | clean) and P(labelled toxic | toxic) of labelled rows, whose states
    the other voters give as ``post``; kept off 0 and 1."""
    says = label == 1
    rates = [((says * w).sum() + 0.5) / (w.sum() + 1) for w in (1 - post, post)]
    return np.clip(rates, 0.01, 0.99)


def with_label(post: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Posteriors of training rows with the label (0, 1, or -1 for none) as one more voter."""
    known = label >= 0
    z = np.log(post / (1 - post))
    if known.any():
        clean, toxic = label_rates(post[known], label[known])
        if toxic > clean:
            z = z + np.where(label == 1, np.log(toxic / clean), np.where(label == 0, np.log((1 - toxic) / (1 - clean)), 0.0))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, features: int = 4096, voter_patterns: int = 400,
        seeds: tuple[str, ...] = SEEDS, least: int = 4, l2: float = 0.3, seed: int = 31,
        learn: Column | None = None) -> tuple[Classifier, LabelModel | None]:
    """The classifier for ``docs`` (doc_id, text), from ``labels`` (doc_id, toxic)
    of the rows that may be learned from. ``learn``: a condition on ``doc_id`` for the
    documents without a label that are trained on (default: any)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = C.stored(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows))
    others = docs.where(F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn)).select("doc_id").distinct()
    others = others.join(F.broadcast(sample), "doc_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    drawn = C.stored(sample.unionByName(others.withColumn("toxic", F.lit(-1))))      # at most 2 * ``fit_rows``
    training = C.stored(docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    fitted = training.where("toxic >= 0")
    mined = mine(fitted, least, features)
    made = voters(mined[:voter_patterns], seeds)
    k = made.n
    votes = C.stored(docs.withColumn("votes", made.votes(F.col("text"))).select("doc_id", "votes"))
    marked = votes.join(F.broadcast(sample), "doc_id", "left").select("votes", F.coalesce("toxic", F.lit(-1)).alias("label"))
    marked = C.stored(marked.groupBy("votes", "label").agg(F.count("*").alias("n")))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    start = np.tile(np.array([[0.02], [0.3]]), (1, k))
    model = label_model(marked, k, max(0.01, min(0.5, n.get(1, 0) / max(1, sum(n.values())))), start)

    known_words = np.array([h & (1 << 64) - 1 for h, _, _ in mined] + [word_hash(w) for w in seeds], U64)
    if not sum(n.values()):
        return Classifier(np.unique(known_words), np.full(len(np.unique(known_words)), 4.0), -2.0), model
    # posterior labels of the training rows, and what tells them
    told = training.select("doc_id", "toxic", "text", made.votes(F.col("text")).alias("votes"))
    states = told.select("doc_id", "toxic", "votes").toPandas()                             # bounded by 2 * ``fit_rows``
    states["q"] = with_label(model.posterior(states["votes"].to_numpy(np.int64)), states["toxic"].to_numpy())
    soft = spark.createDataFrame(states[["doc_id", "q"]], "doc_id long, q double")
    rows = training.join(F.broadcast(soft), "doc_id")
    more = mine(rows.select("text", (F.col("q") >= 0.5).cast("int").alias("toxic")), least, features)
    hashes = np.unique(np.concatenate([known_words, np.array([h & (1 << 64) - 1 for h, _, _ in more], U64)]))
    rows = (rows.select("text", F.col("toxic").cast("long").alias("label"), "q")
            .mapInArrow(lambda it: _hits(it, hashes), "q double, label long, hits array<long>").toPandas())     # bounded by 2 * ``fit_rows``
    if not len(rows):
        return Classifier(hashes, np.full(len(hashes), 4.0), -2.0), model
    hits = [np.asarray(x, np.int64) for x in rows["hits"]]
    w, b = logistic(hits, rows["q"].to_numpy(), len(hashes), l2)
    # one half lies where the labelled rows separate best
    z, toxic, clean = np.array([b + w[x].sum() for x in hits]), (rows["label"] == 1).to_numpy(), (rows["label"] == 0).to_numpy()
    limit = separating_limit(z[toxic], z[clean], 1.0) if toxic.any() and clean.any() else 0.0
    return Classifier(hashes, w, b - (limit if np.isfinite(limit) else 0.0)), model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``; labels
    of held-out rows are not read, nor are such rows trained on."""
    model, _ = fit(docs, labels.where(~held_out(F.col("doc_id"))), learn=~held_out(F.col("doc_id")), **options)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
