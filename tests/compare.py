"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else str(x))
    return df.sort_values(list(df.columns), na_position="last", kind="stable").reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = _sorted(got), _sorted(want)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            ok = ((x - y).abs() <= 2e-6 * (1 + y.abs())) | (x.isna() & y.isna())
        else:
            ok = (a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna())
        assert ok.all(), (c, a[~ok].head(2).to_dict("records"), b[~ok].head(2).to_dict("records"))
