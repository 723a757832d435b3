"""Holds a query's rows against its SQL on DuckDB."""

import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else "nan"
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def same(df, sql, sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = c.sql(sql)
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    want = sorted((tuple(map(norm, r)) for r in found.select(*(f'"{x}"' for x in columns)).fetchall()), key=str)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=str)
    assert got == want
