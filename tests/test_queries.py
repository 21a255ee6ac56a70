"""Every core query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lodestar import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, db, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)


def test_sql_belongs_to_queries():
    assert oracles.oracle_sql().keys() <= queries.queries().keys()
