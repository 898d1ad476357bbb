"""Every registered query with SQL against that SQL, over the whole smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave.catalog.views import TABLES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, db.execute(entry.oracle_sql()[name]).fetchdf()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "weight", "ratio"]
