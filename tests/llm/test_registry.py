import math

import duckdb
import pytest

from lodestar.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = db.sql(registry.oracle_sql()[name])
    at = [list(found.columns).index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)


def test_ten_queries():
    assert [int(n.split("_")[0][2:]) for n in registry.queries()] == list(range(1, 11)) and registry.oracle_sql().keys() <= registry.queries().keys()
