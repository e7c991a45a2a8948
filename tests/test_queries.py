"""Every query with SQL must agree with DuckDB on the smallest tables."""

import os

import pytest
from check_sql import connect, contract, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert difference(got, duck.sql(contract.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["inlp_bank", "deployment_bank"])
def test_trained_query_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_names_and_entry(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 6
