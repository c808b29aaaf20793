"""Every registered query on the smallest data, against its SQL where it has one."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    out = compare(spark, con, SF, name, entry.queries()[name], ORACLES.get(name))
    assert out["ok"], out["why"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
