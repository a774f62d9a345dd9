"""Compares a query with its SQL as run by DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, fn, sql, sf="sf0.001"):
    df = fn(spark, str(DATA / sf))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    assert len(got) == len(want), (name, len(got), len(want), [r for r in got if r not in want][:3], [r for r in want if r not in got][:3])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, len(bad), bad[:3])
    return len(got)
