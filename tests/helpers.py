"""Comparing a query with its SQL oracle."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else datetime.datetime(x.year, x.month, x.day))
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        return "None" if isinstance(x, float) and math.isnan(x) else f"{float(x):.6f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sql: str, sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def differences(spark, query, sql: str, sf_dir: str = SF_DIR) -> str:
    """Empty if the query and its oracle agree in columns and in rows without regard to order."""
    df = query(spark, sf_dir)
    columns, rows = oracle(sql, sf_dir)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(columns, rows)
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
