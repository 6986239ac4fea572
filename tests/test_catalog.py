"""Every registered query can be built and planned, with the columns its SQL names."""

import duckdb
import pytest

from mentiongraph.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_statements_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_planned(spark, tables, name):
    df = QUERIES[name](spark, SF)
    assert df._jdf.queryExecution().executedPlan() is not None
    if name in ORACLE:
        described = tables.execute(f"describe {ORACLE[name]}").fetchall()
        assert sorted(df.columns) == sorted(r[0] for r in described)
