"""Rows of a Spark query and of its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    def text(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v)).lower()
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        try:
            f = float(v)  # type: ignore[arg-type]
            return f"{f:.9g}"
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))


def differences(spark, query, sql: str, sf_dir: str, con) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = plain(got), plain(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, as {bad[0]}" if bad else ""
