"""Compare a query with its SQL counterpart."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


def difference(df, con, sql: str) -> str | None:
    ours, our_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs, their_names = _rows([d[0] for d in result.description], result.fetchall())
    if our_names != their_names:
        return f"columns {our_names} / {their_names}"
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
        return f"rows {len(ours)} / {len(theirs)} {extra}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{our_names}: {a} / {b}"
    return None
