"""Runs a query in Spark and its SQL in DuckDB and compares the rows as sets."""

import decimal
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def sql_rows(sql, directory):
    con = duckdb.connect()
    for name in os.listdir(directory):
        if name.endswith(".parquet"):
            at = os.path.join(directory, name)
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def same(df, sql, directory):
    names, rows = sql_rows(sql, directory)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 2e-5), (a, b)
