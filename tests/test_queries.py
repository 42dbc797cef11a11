"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lexisift import queries
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, duck, name):
    got, want = compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name], small)
    assert got == want


def test_entry(spark, small):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
