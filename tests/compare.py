"""Rows of a Spark query against rows of DuckDB SQL, without regard to order."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def assert_same(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    a = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
