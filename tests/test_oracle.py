"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402
from corpuslens.plans import catalog as contract  # noqa: E402


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, db, name):
    df = contract.queries()[name](spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    columns = [description[0] for description in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows)[1] == digest(columns, result.fetchall())[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
