"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares rows without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(f"{float(value):.9g}")
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    return str(value)


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(tidy(r[k]) for k in order) for r in found), key=repr)


def difference(spark, query, sql: str, sf_dir: str, con) -> str:
    """What differs between the two, or an empty string."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours != theirs:
        only = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        return f"{len(ours)} and {len(theirs)} rows; only in one: {only}"
    return ""
