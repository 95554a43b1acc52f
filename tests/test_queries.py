"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest

from tests.conftest import SF
from tests.oracle import connect, difference

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(found, con, ORACLES[name]) in (None, "both empty")
    else:
        found.count()


def test_entry(spark):
    assert entry_points.entry(spark).columns
