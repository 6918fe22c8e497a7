"""Compare a query with its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else f"{float(v):.6f}"
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        return _cell(v.item())
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """None when equal, else a description."""
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = _rows(want_cols, cur.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}")
    return None
