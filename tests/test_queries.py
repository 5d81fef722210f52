import os

import pytest

import __spark_entry__ as entry
from lumenfold.plans import catalogue
from tests.compare import assert_same, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_what_its_sql_gives(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    assert {r["partition"] for r in entry.entry(spark).collect()} == {"train", "validation", "test"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
