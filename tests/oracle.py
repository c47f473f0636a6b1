"""Compares a query's rows with DuckDB's over the same tables."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = connect(sf_dir).execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in result.description)
    assert got == want
