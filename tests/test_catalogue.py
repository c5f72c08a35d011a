"""Every registered query runs; those with SQL give DuckDB's rows."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from seasonforge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if isinstance(v, Decimal) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    f, sql = catalogue.QUERIES[name]
    d = f(spark, SF)
    got = rows(d.columns, d.collect())
    if sql is None:
        assert got
        return
    want = db.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(d.columns)
    assert got == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
