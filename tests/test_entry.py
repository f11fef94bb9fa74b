"""The driver contract, and every query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check_oracles import TABLES, canonical

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    out = spark_entry.entry(spark)
    assert out.columns[-1] == "is_outlier" and out.count() == 6000


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    frame = QUERIES[name](spark, SF)
    mine = [tuple(r) for r in frame.collect()]
    relation = db.sql(ORACLES[name])
    other = relation.fetchall()
    assert sorted(frame.columns) == sorted(relation.columns)
    assert canonical(mine, frame.columns) == canonical(other, relation.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
