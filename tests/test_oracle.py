"""Every query that has SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

import __spark_entry__
from curatrix.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert len(set(columns)) == len(columns)
        return
    relation = duck.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[k]) for k in at) for r in relation.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_queries_and_sql_agree():
    assert ORACLE_SQL.keys() <= QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
