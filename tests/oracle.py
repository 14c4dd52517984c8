"""Run a registered query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def duck(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql, sf: str = SF) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"{len(a)} vs {len(b)} rows; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"
