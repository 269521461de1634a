"""Pairs meet both their vectors in (user block, item block) cells.

Two joins in a row shuffle one vector with each pair. Here the pairs are dealt to
cells, one for each block of users and block of items, and a cell gets the vectors of
its blocks once: ``users x item blocks + items x user blocks`` vectors are shuffled,
and a pair travels with its ids alone. A task holds the vectors of one cell, streams
the cell's pairs past them and hands each pair on with its two vectors, unchanged.
Blocks are hash ranges of ids of at most ``BLOCK_BYTES`` of vectors; a popular user
or item is spread over the blocks of the other side.

Pairs that are few for so many vectors (cells would copy more vectors than there are
pairs), ids that are no whole numbers and columns that Arrow cannot carry are joined
by Spark's own joins, with the same rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relflow.operators.cells import block_counts, pairs_per_cell
from relflow.session import checkpoint_dir

BLOCK_BYTES = 256 << 20
OUT_ROWS = 8192
SIMPLE = (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class _Vectors:
    """Vectors of one side of a cell, as they came, found by id; an id may have several."""

    def __init__(self):
        self.ids, self.parts = [], []

    def add(self, ids, vectors) -> None:
        self.ids.append(ids.to_numpy(zero_copy_only=False))
        self.parts.append(vectors)

    def ready(self) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # one array in the order of the ids: a take from many chunks would copy them all
        self.parts = pa.concat_arrays(self.parts).take(pa.array(order)) if self.parts else None

    def find(self, ids: np.ndarray):
        first = np.searchsorted(self.ids, ids, "left")
        return first, np.searchsorted(self.ids, ids, "right") - first

    def take(self, at: np.ndarray):
        return self.parts.take(pa.array(at))


def _met(names, user_col: str, item_col: str, result=None):
    """Rows of a partition, by cell: its users' vectors, its items' vectors (kinds 0, 1
    of ``part`` modulo 3), then its pairs. ``result``: makes the columns that are handed on
    from the pairs and their two vectors."""
    def run(batches):
        now, sides = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                cell, kind = divmod(int(key[a]), 3)
                if cell != now:
                    now, sides, waiting = cell, (_Vectors(), _Vectors()), True
                part = batch.slice(a, b - a)
                if kind < 2:
                    sides[kind].add(part.column("id"), part.column("vector"))
                    continue
                if waiting:
                    for s in sides:
                        s.ready()
                    waiting = False
                (u, nu), (v, nv) = (s.find(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                                    for s, c in zip(sides, (user_col, item_col)))
                ends = np.cumsum(nu * nv)       # rows of the join up to each pair
                for s in range(0, int(ends[-1]), OUT_ROWS):
                    place = np.arange(s, min(s + OUT_ROWS, int(ends[-1])))
                    row = np.searchsorted(ends, place, "right")
                    of = place - (ends - nu * nv)[row]
                    rows = part.take(pa.array(row))
                    if result:
                        yield result(rows, sides[0].take(u[row] + of // nv[row]), sides[1].take(v[row] + of % nv[row]))
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(n) for n in names), sides[0].take(u[row] + of // nv[row]), sides[1].take(v[row] + of % nv[row])],
                        names=[*names, "_u", "_v"])
    return run


def with_vectors(pairs: DataFrame, users: DataFrame, items: DataFrame, user_col: str = "user_id", item_col: str = "item_id",
                 block_bytes: int = BLOCK_BYTES, cell_pairs: int | None = None, result=None, columns: T.StructType | None = None) -> DataFrame:
    """The rows of ``pairs`` that have a user and an item vector, with both (``_u``,
    ``_v``): the inner joins on ``user_col`` and on ``item_col``. ``cell_pairs``: pairs
    in a cell (default by their number). ``result(pairs, users' vectors, items' vectors)``
    makes other columns, ``columns``, in the cells; where Spark's joins are used, the rows have
    ``_u`` and ``_v`` all the same."""
    spark = pairs.sparkSession
    u = users.select(F.col(user_col), F.col("factors").alias("_u"))
    v = items.select(F.col(item_col), F.col("factors").alias("_v"))
    joined = pairs.join(u, user_col).join(v, item_col)
    names = joined.columns[:-2]
    whole = all(isinstance(f.schema[c].dataType, T.IntegralType) for f, c in ((pairs, user_col), (pairs, item_col), (u, user_col), (v, item_col)))
    kind = u.schema["_u"].dataType
    if (not whole or user_col == item_col or kind != v.schema["_v"].dataType or not isinstance(kind, T.ArrayType)
            or not all(isinstance(f.dataType, SIMPLE) for f in pairs.schema.fields)):
        return joined
    checkpoint_dir(spark)
    p = stored(pairs.select(*names).where(F.col(user_col).isNotNull() & F.col(item_col).isNotNull()))
    n_pairs = p.count()
    (n_users, ku), (n_items, ki) = (f.agg(F.count(c), F.max(F.size(x))).first() for f, c, x in ((u, user_col, "_u"), (v, item_col, "_v")))
    ub, ib = block_counts(n_users, n_items, n_pairs, max(ku or 1, ki or 1, 1), block_bytes, cell_pairs or pairs_per_cell(n_pairs))
    if n_users * ib + n_items * ub > max(n_pairs, n_users + n_items):
        return p.join(u, user_col).join(v, item_col)
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n))
    cell = block(user_col, ub) * F.lit(ib) + block(item_col, ib)
    # an empty list, not null: on its way to Python Spark measures a batch at every row, for null lists from its start
    rows = p.select(cell.alias("cell"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("id"), F.array().cast(kind).alias("vector"), *names)
    none = [F.lit(None).cast(p.schema[n].dataType).alias(n) for n in names]

    def copies(of: int, table: DataFrame, col: str, vector: str):
        mine = block(col, (ub, ib)[of])
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((ib, ub)[of] - 1).cast("long")))
        t = table.where(F.col(col).isNotNull()).select(mine.alias("_b"), others.alias("_o"), F.col(col).cast("long").alias("id"), F.col(vector).alias("vector"))
        at = F.col("_b") * ib + F.col("_o") if of == 0 else F.col("_o") * ib + F.col("_b")
        return t.select(at.alias("cell"), F.lit(of).alias("kind"), "id", "vector", *none)

    both = copies(0, u, user_col, "_u").unionByName(copies(1, v, item_col, "_v")).unionByName(rows)
    both = (both.repartition(2 * ub * ib, "cell").withColumn("part", F.col("cell") * 3 + F.col("kind"))
            .sortWithinPartitions("part").drop("cell", "kind"))
    schema = columns or T.StructType([T.StructField(n, p.schema[n].dataType) for n in names]
                                     + [T.StructField("_u", kind), T.StructField("_v", kind)])
    return both.mapInArrow(_met(names, user_col, item_col, result), schema)
