"""Every named query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_queries import ORACLES
from pairloom.plans.catalog import QUERIES
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, sql, name):
    df = queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 1
