"""Run queries on Spark and their oracle SQL on DuckDB and compare the values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_rows(sf_dir: str, statement: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(statement)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    con.close()
    return names, rows


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(lines, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, sf_dir: str, statement: str):
    """None if equal, else a short description of the first difference."""
    s_names, s_rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    d_names, d_rows = canonical(*duckdb_rows(sf_dir, statement))
    if s_names != d_names:
        return f"columns {s_names} != {d_names}"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} rows != {len(d_rows)}"
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return f"{a} != {b}"
    return None
