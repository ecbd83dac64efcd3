"""Rows of a Spark query against the rows of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def check(spark, query, sql: str, sf_dir: str = SMALL) -> None:
    df = query(spark, sf_dir)
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
