"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ballast.catalog import ORACLES, QUERIES
from tools.check_oracles import compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


# Minutes long on any table, as they fit over a hundred models: tools/check_oracles.py runs them.
LONG = {"grid_search", "run_experiment"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_matches_sql(spark, duck, name):
    text, _, good = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert good, text


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
