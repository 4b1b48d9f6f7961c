"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns, (name, rel.columns, columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (name, a, b)
    return len(got)
