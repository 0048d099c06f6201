"""Compares a Spark query with its DuckDB text, whatever the order of rows and columns."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    ran = con.execute(sql)
    expected = rows([c[0] for c in ran.description], ran.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for g, e in zip(got[1], expected[1], strict=True):
        assert repr(g) == repr(e)
