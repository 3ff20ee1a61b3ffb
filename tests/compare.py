"""Spark result against SQL result, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.generic):
        v = v.item()
        return plain(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        v = pd.Timestamp(v)
        return v.isoformat() if (v.hour or v.minute or v.second or v.microsecond) else v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else what differs."""
    left_names = spark_df.columns
    left = rows(left_names, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_names = [d[0] for d in cursor.description]
    right = rows(right_names, cursor.fetchall())
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} / {sorted(right_names)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}: only left {[r for r in left if r not in set(right)][:2]} only right {[r for r in right if r not in set(left)][:2]}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{sorted(left_names)}\n{a}\n{b}"
    return ""
