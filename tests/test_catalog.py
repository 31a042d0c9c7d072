"""Every registered query beside its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert "title" in df.columns and df.count() > 0
