"""Side-by-side check of a Spark DataFrame against a DuckDB SQL text (dev + test helper).

Mirrors the driver's gate: same column names, same row count, same multiset of values
(order-insensitive; floats compared after rounding to 6 places).
"""

from __future__ import annotations

import math

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (np.floating,)):
        return _norm(float(v))
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    ok_cols = sc == dc
    ok_n = len(sr) == len(dr)
    ok_v = sr == dr
    detail = ""
    if not ok_cols:
        detail = f"cols spark={sc} duck={dc}"
    elif not ok_n:
        detail = f"rows spark={len(sr)} duck={len(dr)}"
    elif not ok_v:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        detail = f"values differ, e.g. {diff}"
    return ok_cols and ok_n and ok_v, len(sr), detail
