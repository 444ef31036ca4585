"""Order-free comparison of a Spark result with its check SQL."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

EXACT = os.environ.get("COMPARE_EXACT") == "1"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(v) if EXACT else round(float(v), 9)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = rows(got_names, got), rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; e.g. {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{str(x)[:300]} != {str(y)[:300]}"
    return None
