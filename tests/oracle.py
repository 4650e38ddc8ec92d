"""Compares a query with its DuckDB oracle."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v).replace(" 00:00:00", "")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r])


def same_as_oracle(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    df = query(spark, sf_dir)
    assert set(df.columns) == set(names)
    want, got = rows_of(names, expected.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got)
    for a, b in zip(want, got):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x))), (a, b)
