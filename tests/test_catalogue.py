"""Every query beside its SQL, at a small scale: the same rows, the same types."""

import datetime
import decimal

import duckdb
import pytest

from corpusloom.plans import catalogue

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = ordered(tuple(r[i] for i in at) for r in found.fetchall())
    assert got == want
    for row in want:
        assert not any(isinstance(x, (decimal.Decimal, datetime.timedelta)) for x in row)


def test_others_run_twice_alike(spark, sf):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)):
        first, second = (ordered(tuple(r) for r in catalogue.QUERIES[name](spark, sf).collect()) for _ in range(2))
        assert first and first == second


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
