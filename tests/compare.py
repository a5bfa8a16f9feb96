"""Comparing a query with its SQL in DuckDB: column names, number of rows, and values without order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v if isinstance(v, (str, bytes)) else str(v)


def by_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    c.execute(sql)
    return [d[0] for d in c.description], c.fetchall()


def differences(df, sf_dir: str, sql: str) -> str:
    """Empty where both agree."""
    names, rows = by_sql(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    if mine == theirs:
        return ""
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
