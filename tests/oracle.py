"""Run a registered query and its SQL twin and compare rows, order-insensitive."""

from __future__ import annotations

import datetime as dt
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.sql(sql)
    return rows(list(rel.columns), rel.fetchall())


def difference(df, con, sql):
    """None when equal, else a short text."""
    cols_a, a = spark_rows(df)
    cols_b, b = sql_rows(con, sql)
    if cols_a != cols_b:
        return f"columns differ: {cols_a} vs {cols_b}"
    if a == b:
        return None if a else "both empty"
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows; only spark {only_a}; only sql {only_b}"
