"""Compares a query with its SQL in DuckDB, as sets of rows with values in one form."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x) -> str:
    if x is None:
        return "~"
    if isinstance(x, float):
        return "~" if math.isnan(x) else repr(round(x, 5) + 0.0)
    if isinstance(x, bool):
        return str(x)
    return repr(x) if isinstance(x, str) else str(int(x)) if hasattr(x, "__int__") else str(x)


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(shown(r[k]) for k in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> tuple[list[str], list[str], Counter, Counter]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    return sorted(df.columns), sorted(names), got - want, want - got
