"""Every registered query against its DuckDB statement on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans.oracles import ORACLES
from ledgerline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool)
                         else r[i] for i in order) for r in rows), key=str)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, tables, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert normal(frame.collect(), frame.columns) == normal(result.fetchall(), columns)
