"""Compare a registered Spark query with its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tillroll.plans.fixtures import BASE_TABLES


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False  # set True to compare floats without rounding


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f if EXACT else float(f"{f:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [cols[i] for i in order]


def compare(spark, con, name: str, sf_dir: str, queries, oracles):
    sdf = queries[name](spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    res = con.execute(oracles[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    s_sorted, s_names = _rows(scols, srows)
    d_sorted, d_names = _rows(dcols, drows)
    problems = []
    if s_names != d_names:
        problems.append(f"columns differ: spark={s_names} duck={d_names}")
    if len(s_sorted) != len(d_sorted):
        problems.append(f"row count spark={len(s_sorted)} duck={len(d_sorted)}")
    elif s_sorted != d_sorted:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
        problems.append(f"{len(diff)} rows differ, first: {diff[:2]}")
    return problems, len(srows)
