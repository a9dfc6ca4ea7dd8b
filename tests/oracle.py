"""Runs registered queries beside their DuckDB statements."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x is None or (isinstance(x, float) and x != x) or x is pd.NA else x for x in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if any((p != q) and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(q))) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} rows differ, such as {bad[:2]}" if bad else ""
