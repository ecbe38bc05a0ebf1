"""Queries against their SQL, value by value."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in os.listdir(d):
        con.sql(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{d}/{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v: object) -> object:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool | np.bool_):
            return bool(v)
        if isinstance(v, int | float | np.number):
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def compare(spark, con, query, sql: str, d: str) -> None:
    got, want = query(spark, d).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
