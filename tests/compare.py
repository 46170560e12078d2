"""Compare a query's result with its SQL, as unordered rows under sorted column names."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _rows(names, cursor.fetchall())


def differences(df, con, sql):
    """None when equal, else a short description."""
    names, got = spark_rows(df)
    want_names, want = sql_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    types = {tuple(type(v).__name__ for v in row if v is not None) for row in list(got)[:50]}
    want_types = {tuple(type(v).__name__ for v in row if v is not None) for row in list(want)[:50]}
    if got == want and (types == want_types or not types):
        return None
    if got == want:
        return f"types {types} != {want_types}"
    return (
        f"{sum(got.values())} rows, expected {sum(want.values())}; "
        f"extra {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"
    )
