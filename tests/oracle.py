"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares all values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted("|".join(plain(r[k]) for k in order) for r in found)


def differences(spark, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connected(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cursor.fetchall())
    return [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3] or (len(got), len(want)) * (len(got) != len(want))
