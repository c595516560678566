"""Both sides of a query as sorted rows of plain values."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or pd.isna(value):
        return None
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    return int(value) if isinstance(value, (int, np.integer)) else str(value)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))
