"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.session import checkpoint_dir

U64 = np.uint64
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------- stored tables

def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder."""
    sc = spark.sparkContext
    d = f"{checkpoint_dir(spark).rstrip('/')}/llm-{sc.applicationId}"
    if not getattr(sc, "_relflow_llm_scratch", False):
        sc._relflow_llm_scratch = True
        atexit.register(_delete, sc, d)
    return d


def _delete(sc, d: str) -> None:
    if sc._jsc is not None and sc._gateway is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: the
    lineage is cut, a lost executor costs no recomputation of earlier steps,
    and its size is known to later joins. Deleted when the application ends. Shuffle
    files that no DataFrame needs any more go first."""
    release(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH)
    for made in _STEPS:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STEPS: list[list[str]] = []        # tables stored by each step that is going on


def step(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` stored. The tables that were stored on the way to it are deleted and
    its shuffle files let go of: a table that ``make`` stores must have no other use."""
    _STEPS.append([])
    try:
        out = stored(make())
    finally:
        made = _STEPS.pop()
    for path in made[:-1]:      # the last one is the result
        _delete(spark.sparkContext, path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of DataFrames that are gone when the driver's JVM
    collects them, by itself only every half hour: until then a finished step's files
    would fill the disks beside the next one's."""
    gc.collect()        # Python's handles first
    spark.sparkContext._jvm.System.gc()


def small(table: DataFrame, n: int) -> DataFrame:
    """A table of known length: broadcast up to 100,000 rows, joined by a shuffle beyond."""
    return F.broadcast(table) if n <= 100_000 else table


def in_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a table of files as it was read, else a stored copy."""
    node = docs._jdf.queryExecution().analyzed().nodeName()
    return docs if "Relation" in node and docs.inputFiles() else stored(docs)


def place(docs: DataFrame) -> list[Column]:
    """A row's file and its number there: however the files are split among
    tasks, a later scan finds the same row under them."""
    at = docs.metadataColumn("_metadata")
    return [at["file_path"].alias("__file"), at["row_index"].alias("__place")]


# ------------------------------------------------------------ words as hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19          # bytes of text handled at once
_BATCH = "8m"             # of an Arrow batch, so that long texts come few at a time
_LONG_WORD = 256          # longer words are hashed by blake2b


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _codes(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
    if lower:
        t[65:91] = t[97:123]
    return t


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLES: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("powers")
    if have is None or len(have[0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _CHUNK), b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        if n > 8 * _CHUNK:      # one huge word: not kept
            return tuple(out)
        have = _TABLES["powers"] = tuple(out)
    return have


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    if off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_ranges(offsets: np.ndarray, limit: int = _CHUNK):
    """Consecutive (first, last + 1) rows of at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _words_of(x: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the bytes ``x``; a word also ends where a text
    starts. Returns (hash, position of the word's first byte)."""
    solid = ~_IS_SPACE[x]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(x))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(x, s, e, lower), s


def span_hashes(x: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of each span ``x[s:e]``, the same wherever it stands."""
    p, inv = _powers(len(x))
    key = ("codes", lower)
    if key not in _TABLES:
        _TABLES[key] = _codes(lower)
    cum = np.zeros(len(x) + 1, U64)
    np.cumsum(_TABLES[key][x] * p[:len(x)], out=cum[1:])
    h = mix((cum[e] - cum[s]) * inv[s] + (e - s).astype(U64) * U64(_STEP))
    for i in np.flatnonzero(e - s > _LONG_WORD):
        w = x[s[i]:e[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(w.lower() if lower else w, digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, in order, and the text's number for
    each word. Only A-Z are lower-cased. A text longer than a chunk is cut at
    white space, so memory follows the number of words, not eight times the bytes."""
    if len(offsets) == 2 and len(data) > 2 * _CHUNK:
        hs, at = [], 0
        while at < len(data):
            end = min(len(data), at + _CHUNK)
            while end < len(data):
                gaps = np.flatnonzero(_IS_SPACE[data[end:end + _CHUNK]])
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(len(data), end + _CHUNK)
            hs.append(_words_of(data[at:end], np.zeros(0, np.int64), lower)[0])
            at = end
        h = np.concatenate(hs)
        return h, np.zeros(len(h), np.int64)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, s = _words_of(data, offsets[:-1], lower)
    return h, np.searchsorted(offsets, s, "right") - 1


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


# --------------------------------------------------------------- number helpers

def hash_unit(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from a hash of columns: the same on every run and
    under every partitioning."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096):
    """The exact ``k``-th largest value of a double column (None: fewer rows),
    by repeated equal-width histograms: one small aggregate a round, no sort
    and no rows at the driver."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        width = (hi - lo) / bins
        part = df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))
        if width <= 0 or lo + width == lo:
            where = F.col(col)      # neighbours: a bin for each value
        else:
            where = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width)))
        rows = part.groupBy(where.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"),
                                                  F.max(col).alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


# --------------------------------------------------------- connected components

def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges, as edges from each node to its component's
    smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:     # hook roots to smaller ones, then jump
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(frames):
    held = list(frames)
    if held:
        u, v = spanning(np.concatenate([f["u"].to_numpy() for f in held]), np.concatenate([f["v"].to_numpy() for f in held]))
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)`` with
    the smallest node as component, for every node but the components' own
    smallest ones. Union-find in distributed form: each task first contracts the
    edges it holds, then large-star and small-star rounds - aggregates and
    equi-joins on node ids - run until all edges lead straight to a smallest node.
    Each round is stored in the shared folder."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e)
    # a node's edges are dealt to tasks of bounded size, whatever its degree
    e = stored(e.mapInPandas(_contract, "u long, v long").distinct())
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u's smaller neighbours and u itself move to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))))
        e = stored(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_stars(e: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none."""
    ends = e.groupBy("u").agg(F.count("*").alias("out")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("out")).distinct())
    wrong = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("roles")).where("out > 1 OR roles > 1")
    return not wrong.limit(1).count()
