"""Runs a query and its SQL over the same Parquet files and compares the rows as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if glob.glob(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/**/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _value(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def rows_of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(_value(row[k]) for k in order) for row in r.fetchall())


def rows_of(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(_value(row[k]) for k in order) for row in df.collect())


def difference(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    (a, x), (b, y) = rows_of(df), rows_of_sql(c, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{x.total()} and {y.total()} rows; only Spark {list((x - y).items())[:4]}; only SQL {list((y - x).items())[:4]}"
    return "" if x else "no rows"
