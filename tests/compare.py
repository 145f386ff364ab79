"""Rows of a query against the rows of its SQL, as multisets of normalised values."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return value(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def oracle(sql: str, d: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def differences(df, sql: str, d: str) -> str:
    """What differs, or an empty string."""
    columns, rows = oracle(sql, d)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    order = sorted(columns)
    got = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(value(r[columns.index(c)]) for c in order) for r in rows)
    if got == want:
        return ""
    return f"{order}: {sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}, only in SQL {list((want - got).items())[:2]}"
