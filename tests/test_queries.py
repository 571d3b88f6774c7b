"""Every registered query with SQL gives DuckDB's rows, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tagloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    wanted = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(wanted.fetchall(), wanted.columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
