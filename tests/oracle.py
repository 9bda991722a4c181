"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    return str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, con, build, sql, folder):
    """None when equal, else a short description of the difference."""
    df = build(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] == right[1]:
        return None if left[1] else "both empty"
    a, b = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
    return f"{left[0]} rows {len(left[1])} vs {len(right[1])}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}"
