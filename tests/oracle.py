"""Runs a registered query and its SQL on the same files and compares the rows as multisets."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v)) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in records)


def duck(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, str(folder))
    got = rows_of(df.collect(), df.columns)
    spent = time.time() - start
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns), f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"
    missing, extra = want - got, got - want
    assert not missing and not extra, (
        f"{name}: {sum(missing.values())} rows missing, {sum(extra.values())} extra of {sum(want.values())}; "
        f"e.g. want {list(missing)[:2]} got {list(extra)[:2]}")
    types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    return sum(got.values()), spent, {c: (t, types.get(c)) for c, t in df.dtypes}
