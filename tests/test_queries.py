"""Every registered query of the library with SQL gives the same rows and types on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from driftline.registry import ORACLE, QUERIES
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_inventory_orders_and_accounting_are_registered():
    names = {"E11_smallest_remaining", "O1_object_order", "O2_global_order", "O3_numeric_id_order", "O6_first_best", "T12_row_accounting"}
    assert names <= set(QUERIES) and names <= set(ORACLE)


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "first_fire" in df.columns


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    if name in ORACLE:
        assert result.startswith("ok (") and "types" not in result, result
    else:
        assert result.startswith("rows only (") and result != "rows only (0)", result
