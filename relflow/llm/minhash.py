"""Near-duplicate texts: SuperMinHash signatures, banding, verification on full
shingle sets, union-find grouping.

A text's words are its runs of other characters than ASCII white space, A-Z
lower-cased; its set holds the distinct five-word shingles (with fewer words:
the whole sequence as one; without words: empty). Texts with the same set form
a class, named by its smallest ``doc_id``; only classes are compared, copies are
never expanded into pairs.

SuperMinHash: every element draws a random permutation of the signature's
places, step by step (Fisher-Yates), and a random number per step; a place keeps
the smallest ``step + number`` offered to it. Steps run over all elements of a
text at once; when every place holds less than the next step, later steps can't
change anything, and the text stops early.

Candidates and their check, per band bucket (classes that agree in all rows of a
band): a class's degree is the number of classes in its buckets. In each bucket
every class is compared with the class of highest degree - for a family of
edited copies that is their common origin, whose bands are the usual ones. This
is linear in the bucket. What stays apart in a bucket of three or more is then
compared exactly, every two classes of different components, on their full sets:
the bucket is cut into blocks of bounded size, and each two blocks meet in a task
that returns the links it needs to connect what they connect, never all pairs.

Rows: every input row gets one output row. Null text counts as empty; an empty
set links with nothing (``component_id = doc_id``). A null ``doc_id`` can't be
named: its ``component_id`` is null, ``kept`` false. Repeated rows and rows that
share a ``doc_id`` are one node with the links of all its texts. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relflow.llm import common as C

U64 = C.U64
_ODD = C.mix(np.arange(11, 17, dtype=U64)) | U64(1)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words per text: (sorted hashes, set sizes)."""
    count = np.bincount(doc, minlength=n_docs)
    odd = np.resize(_ODD, k)
    odd = odd + U64(2) * np.arange(k, dtype=U64)
    full = np.zeros(0, U64)
    if len(words) >= k:
        full = words[:len(words) - k + 1] * odd[0]
        for i in range(1, k):
            full = full + words[i:len(words) - k + 1 + i] * odd[i]
        full = C.mix(full)
    first = np.concatenate([[0], np.cumsum(count)])
    out, sizes = [], np.zeros(n_docs, np.int64)
    for d in np.flatnonzero(count):
        a, n = first[d], count[d]
        if n >= k:
            s = np.sort(full[a:a + n - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            with np.errstate(over="ignore"):
                s = C.mix(np.array([(words[a:a + n] * odd[:n]).sum(dtype=U64) + U64(n) * _ODD[5]], U64))
        out.append(s)
        sizes[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), sizes


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of sets given as flat element hashes and the
    set's number for each. Sets without elements keep the largest value."""
    top = (1 << 64) - 1
    sig = np.full(n_docs * m, top, U64)
    el, row, perm = elements, doc, None
    for j in range(m):
        if not len(el):
            break
        rnd = C.mix(el + U64((j + 1) * 0x9E3779B97F4A7BDB & top))
        k = j + ((rnd & U64(0xFFFFFFFF)) * U64(m - j) >> U64(32)).astype(np.int64)
        here = np.arange(len(el))
        if j == 0:
            place, step0 = k, k
        else:
            if perm is None:        # swap of step 0, for the elements that go on
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(el), 1))
                perm[here, step0] = 0
                perm[here, 0] = step0
            place = perm[here, k].astype(np.int64)
            perm[here, k] = perm[here, j]
            perm[here, j] = place
        np.minimum.at(sig, row * m + place, (U64(j) << U64(32)) | (rnd >> U64(32)))
        open_ = sig.reshape(n_docs, m).max(axis=1) >= (U64(j + 1) << U64(32))
        go = open_[row]
        if not go.all():
            el, row = el[go], row[go]
            step0 = step0[go]
            perm = perm[go] if perm is not None else None
    return sig.reshape(n_docs, m)


def _sets(batch: pa.RecordBatch, k: int):
    """(rows a to b, elements, sizes) for the texts of an Arrow batch."""
    data, off = C.text_buffers(batch.column("text"))
    for a, b in C.doc_ranges(off):
        words, doc = C.word_hashes(data[off[a]:off[b]], off[a:b + 1] - off[a])
        el, sizes = shingle_hashes(words, doc, b - a, k)
        yield a, b, el, sizes


def _set_keys(el: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each set, whatever the order of its elements."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    keys = []
    for salt in (0x1234567, 0x89ABCDE):
        c = np.concatenate([[U64(0)], np.cumsum(C.mix(el ^ U64(salt)), dtype=U64)])
        keys.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
    return keys


def _sketch(batches, k: int, m: int):
    for batch in batches:
        for a, b, el, sizes in _sets(batch, k):
            n = b - a
            sig = C.mix(superminhash(el, np.repeat(np.arange(n), sizes), n, m)) >> U64(32)
            k1, k2 = _set_keys(el, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), pa.array(sizes), pa.array(k1), pa.array(k2),
                 C.list_array(sig.astype(np.uint32).view(np.int32).ravel(), np.full(n, m), pa.int32())],
                ["doc_id", "n_shingles", "k1", "k2", "sig"])


def _full_sets(batches, k: int):
    for batch in batches:
        for a, b, el, sizes in _sets(batch, k):
            k1, k2 = _set_keys(el, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(k1), pa.array(k2),
                 C.list_array(el.view(np.int64), sizes, pa.int64())],
                ["class_id", "k1", "k2", "items"])


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The full sets ``(class_id, items)`` of the wanted classes (class_id), stored."""
    wanted = C.stored(wanted.distinct())
    texts = docs.join(wanted.withColumnRenamed("class_id", "doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda it: _full_sets(it, k), "class_id long, k1 long, k2 long, items array<long>")
    # a doc_id may have other rows with other texts: only the class's own set counts
    own = classes.join(wanted, "class_id", "left_semi").select("class_id", "k1", "k2")
    return C.stored(sets.join(own, ["class_id", "k1", "k2"], "left_semi").select("class_id", "items"))


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("class_id").alias("b"), F.col("items").alias("y")), "b")
            .join(sets.select(F.col("class_id").alias("a"), F.col("items").alias("x")), "a"))
    inter = F.size(F.array_intersect("x", "y"))
    return both.where(100 * inter >= percent * (F.size("x") + F.size("y") - inter)).select("a", "b").distinct()


def _shared_elements(xa: np.ndarray, ra: np.ndarray, n: int, xb: np.ndarray, rb: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of ``n`` sets with ``m`` sets, given as elements
    and set numbers."""
    both = np.intersect1d(xa, xb)
    out = np.zeros((n, m), np.float32)
    sides = []
    for x, r in ((xa, ra), (xb, rb)):
        at = np.searchsorted(both, x)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == x[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], r[hit][order]))
    for c in range(0, len(both), 4096):
        part = []
        for (at, r), k in zip(sides, (n, m)):
            i, j = np.searchsorted(at, [c, c + 4096])
            z = np.zeros((k, 4096), np.float32)
            z[r[i:j], at[i:j] - c] = 1
            part.append(z)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _compare(frames, percent: int):
    """Links between different components in two blocks of a bucket, as far as
    they are needed to connect what they connect."""
    for pdf in frames:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in pdf.itertuples(index=False):
            ia, ca, na = np.asarray(r.ids), np.asarray(r.comps), np.asarray(r.ns, np.int64)
            ib, cb, nb = np.asarray(r.ids2), np.asarray(r.comps2), np.asarray(r.ns2, np.int64)
            may = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
            if not may.any():
                continue
            sets = []
            for items, n, use in ((r.items, na, may.any(axis=1)), (r.items2, nb, may.any(axis=0))):
                row = np.repeat(np.arange(len(n)), n)
                keep = use[row]
                sets += [np.asarray(items)[keep], row[keep], len(n)]
            inter = _shared_elements(*sets)
            i, j = np.nonzero(may & (100 * inter >= percent * (na[:, None] + nb - inter)))
            if len(i):
                u, v = C.spanning(ia[i], ib[j])
                us.append(u)
                vs.append(v)
        yield pd.DataFrame({"a": np.concatenate(us), "b": np.concatenate(vs)}).drop_duplicates()


def _links_between(docs: DataFrame, classes: DataFrame, shared: DataFrame, found: DataFrame, k: int, percent: int, block: int, span: int) -> DataFrame:
    """Links between classes of different components ``found`` that share a bucket:
    enough of them to connect what all of them connect."""
    in_bucket = shared.where("size > 2").join(found, shared["class_id"] == found["node"], "left").select(
        "bucket", "class_id", "size", F.coalesce("component", "class_id").alias("comp"))
    split = in_bucket.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    members = C.stored(in_bucket.join(split, "bucket"))
    sets = _sets_of(docs, classes, members.select("class_id"), k)
    parts = F.ceil(F.col("size") / block)
    packed = C.stored(members.join(sets, "class_id").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "class_id"), "parts"))
                      .groupBy("bucket", "parts", "part").agg(F.collect_list(F.struct("class_id", "comp", F.size("items").alias("n"), "items")).alias("r"))
                      .select("bucket", "parts", "part", F.col("r.class_id").alias("ids"), F.col("r.comp").alias("comps"),
                              F.col("r.n").alias("ns"), F.flatten("r.items").alias("items")))
    names = ("ids", "comps", "ns", "items")
    one = packed.where("parts = 1").select(*names, *[F.col(c).alias(c + "2") for c in names])
    # a long bucket is dealt to cells of ``span`` by ``span`` blocks, each a key of its own, so its pairs spread over tasks
    of, spans = F.floor(F.col("part") / span).cast("long"), F.ceil(F.col("parts") / span).cast("long")
    cells = (packed.where("parts > 1").withColumn("mine", of).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)))
             .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")))
    left = cells.where("mine = low").select("bucket", "low", "high", "part", *names)
    right = cells.where("mine = high").select("bucket", "low", "high", F.col("part").alias("part2"), *[F.col(c).alias(c + "2") for c in names])
    many = (left.join(right, ["bucket", "low", "high"]).where("low < high OR part <= part2")
            .select(*names, *[c + "2" for c in names]))
    return one.unionByName(many).mapInPandas(lambda it: _compare(it, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 16, rows: int = 4,
                    block: int = 256, span: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``
    (doc_id, text). Texts are linked when ``100 * |A n B| >= percent * |A u B|``;
    a pair at the limit of 0.85 shares one of 16 bands of 4 places with a
    probability of 0.99999."""
    m = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = C.stored(docs.mapInArrow(lambda it: _sketch(it, k, m),
                                      "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"))
    named = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = C.stored(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"),
                                                     F.min_by("sig", "doc_id").alias("sig"),
                                                     F.first("n_shingles").alias("n")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, F.lit(rows))))
    banded = classes.select("class_id", "n", F.explode(keys).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = C.stored(banded.join(sizes, "bucket"))
    degree = shared.groupBy("class_id").agg(F.sum("size").alias("degree"))
    centre = (shared.join(degree, "class_id").groupBy("bucket")
              .agg(F.max(F.struct("degree", (-F.col("class_id")).alias("minus"), "n")).alias("top"))
              .select("bucket", (-F.col("top.minus")).alias("centre"), F.col("top.n").alias("n_centre")))
    fits = F.least("n", "n_centre") * 100 >= F.greatest("n", "n_centre") * percent
    star = C.stored(shared.join(centre, "bucket").where(fits & (F.col("class_id") != F.col("centre")))
                    .select(F.least("class_id", "centre").alias("a"), F.greatest("class_id", "centre").alias("b")).distinct())
    ends = star.select(F.col("a").alias("class_id")).unionByName(star.select(F.col("b").alias("class_id")))
    links = C.stored(_confirmed(_sets_of(docs, classes, ends, k), star, percent))
    more = _links_between(docs, classes, shared, C.components(links, "a", "b"), k, percent, block, span)

    # rows that share a doc_id but not a text belong together
    members = named.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"]).select("doc_id", "class_id")
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a < z")
    same = members.join(several, "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b").distinct()
    found = C.components(links.unionByName(more).unionByName(same), "a", "b")
    groups = classes.join(found, classes["class_id"] == found["node"], "left").select(
        "k1", "k2", F.coalesce("component", "class_id").alias("component_id"))
    out = sketch.withColumn("has", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(
        groups.withColumn("has", F.lit(True)), ["k1", "k2", "has"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near-duplicates: one row of each group stays, the one with
    the smallest ``doc_id`` (null last), then the first by file and place. Rows are told
    apart by file and place, so different texts under one ``doc_id`` or without one are
    different documents; rows without words all stay."""
    docs = C.in_files(docs)
    files = docs.select(*C.place(docs)).select("__file").distinct()
    files = C.stored(files.withColumn("__no", F.row_number().over(Window.orderBy("__file")).cast("long")))     # one row a file
    files = C.small(files, files.count())
    row = (F.col("__no") * (1 << 40) + F.col("__place")).alias("__row")

    def numbered(column):
        return docs.select(*C.place(docs), column).join(files, "__file")

    groups = near_duplicates(numbered(F.col("text")).select(row.alias("doc_id"), "text"), **options)
    names = numbered(F.col("doc_id").cast("long").alias("__id")).select(row, "__id", "__file", "__place")
    first = F.min(F.struct(F.col("__id").isNull().alias("nameless"), "__id", "__row", "__file", "__place"))
    kept = (groups.join(names, F.col("doc_id") == F.col("__row")).groupBy("component_id").agg(first.alias("first"))
            .select(F.col("first.__file").alias("__kept_file"), F.col("first.__place").alias("__kept")))
    kept = C.stored(kept)
    rows = docs.select(F.struct("*").alias("__doc"), *C.place(docs))
    return rows.join(kept, (F.col("__place") == F.col("__kept")) & (F.col("__file") == F.col("__kept_file")), "left_semi").select("__doc.*")
