"""Order-insensitive result comparison used by the tests and the check tool."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb


def norm(v, exact: bool):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if exact else (0.0 if v == 0 else float(f"{v:.6g}"))
    if isinstance(v, dt.datetime) and v.hour == v.minute == v.second == v.microsecond == 0:
        v = v.date()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, data, exact: bool):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i], exact) for i in order) for r in data), key=repr)


def duck(sf_dir: str, tables) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(sdf, con, sql: str, exact: bool = False) -> tuple[bool, str]:
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    if sorted(sdf.columns) != sorted(dcols):
        return False, f"columns differ: {sorted(set(sdf.columns) ^ set(dcols))}"
    if len(srows) != len(drows):
        return False, f"row counts {len(srows)} vs {len(drows)}"
    a, b = canon(sdf.columns, srows, exact), canon(dcols, drows, exact)
    if a != b:
        diff = [x for x, y in zip(a, b) if x != y][:2]
        return False, f"values differ, e.g. {diff}"
    return True, "ok"
