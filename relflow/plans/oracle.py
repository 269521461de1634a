"""Compare a registered query with its DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from relflow.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm_value(v) for v in rec))
    return cols, sorted(out, key=repr)


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                  "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
                  "SMALLINT": "smallint", "TINYINT": "tinyint"}


def type_mismatches(spark_df, con, sql: str) -> list[str]:
    """Columns whose Spark type differs from the DuckDB result type."""
    rel = con.sql(sql)
    duck_t = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out = []
    for c, t in spark_df.dtypes:
        d = duck_t.get(c)
        if d is None or _DUCK_TO_SPARK.get(d.split("(")[0], d) != t:
            out.append(f"{c}: spark={t} duckdb={d}")
    return out


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    res = {"spark_rows": len(sr), "oracle_rows": len(dr), "cols_match": sc == dc,
           "spark_cols": sc, "oracle_cols": dc}
    res["type_mismatches"] = type_mismatches(spark_df, con, sql)
    res["values_match"] = res["cols_match"] and sr == dr
    if not res["values_match"] and res["cols_match"]:
        ss, ds = set(sr), set(dr)
        res["only_spark"] = list(ss - ds)[:3]
        res["only_oracle"] = list(ds - ss)[:3]
    return res
