"""Compare a Spark result with its SQL oracle: columns by name, rows as a multiset."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else a short description of the difference, plus the row count."""
    got = df.collect()
    gc, g = rows_of(df.columns, got)
    cur = con.execute(sql)
    wc, w = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}", len(got)
    if g != w:
        return (f"rows {sum(g.values())} vs {sum(w.values())}; only spark {sum((g - w).values())}: {list((g - w))[:3]}; "
                f"only sql {sum((w - g).values())}: {list((w - g))[:3]}"), len(got)
    return None, len(got)
