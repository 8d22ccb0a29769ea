"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from foliant.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    out = catalogue.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in catalogue.SQL:
        assert out.columns
        return
    res = db.execute(catalogue.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(out.columns)
    want = [tuple(plain(r[names.index(c)]) for c in out.columns) for r in res.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(plain(v) for v in r)) for r in rows)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
