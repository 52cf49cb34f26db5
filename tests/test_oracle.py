"""Every registered query against its check SQL, over the smallest tables."""

import pytest
from oracle import compare, connect

from racebook.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    state, note, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert state in ("OK", "EMPTY"), note


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
