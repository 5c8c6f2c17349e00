"""Compare a query with its SQL in DuckDB: row count, column names and values, in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "inf" if math.isinf(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql: str, sf_dir: str) -> str | None:
    """None if they agree, else what differs."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want_rows)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if got != want:
        return f"{order}: {sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None
