"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as entry
from tests import oracle
from visitwise.catalog import registry

# The queries of the optional parts are tested beside those parts.
QUERIES = {name: fn for name, fn in entry.queries().items() if name in registry.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in registry.ORACLES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, sf_dir, name):
    columns, rows = oracle.spark_result(QUERIES[name](spark, sf_dir))
    want_columns, want = oracle.duck_result(con, ORACLES[name])
    assert columns == want_columns
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
