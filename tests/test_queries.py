"""Every registered query against its SQL equivalent on the smallest tables."""

import os

import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF))
    oracle = entry.oracle_sql()
    if name in oracle:
        assert difference(got, duck_rows(con, oracle[name])) is None
    else:
        assert got[1]


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
