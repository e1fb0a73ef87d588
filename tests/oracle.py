"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def norm(v: object) -> object:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def expected(sql: str, sf: str = SF) -> tuple[list[str], list]:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = c.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows(columns, cur.fetchall())


def check(spark, query, sql: str, sf: str = SF) -> None:
    df = query(spark, sf)
    got = sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == expected(sql, sf)
