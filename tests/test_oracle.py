"""Every registered query against its SQL, by value."""

import os

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from hopline.plans.catalog import CATALOG
from hopline.plans.oracle import ORACLE, ROWS_ONLY

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    if name in ROWS_ONLY:
        assert df.count() > 0
    else:
        assert differences(df, con, contract.oracle_sql()[name]) is None


def test_registry_is_complete():
    assert set(CATALOG) == set(ORACLE) | set(ROWS_ONLY)
    assert set(CATALOG) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).collect() == [(652,)]
