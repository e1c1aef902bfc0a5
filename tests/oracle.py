"""Comparison of a query with its SQL, the way a driver would do it: columns by name, rows as a multiset."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(d: str):
    c = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return c


def _cell(x) -> str:
    if isinstance(x, (list, tuple)) or hasattr(x, "shape"):
        return str(list(x))
    if pd.isna(x):
        return "NULL"
    if isinstance(x, bool) or "bool" in type(x).__name__ or "int" in type(x).__name__:
        return str(int(x))
    if isinstance(x, float):
        return repr(float(x)) if x != int(x) else str(int(x))
    return str(x)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
