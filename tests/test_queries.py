"""Every registered query against its SQL counterpart, over whole tables."""

import pytest
from compare import compare, connect, difference

from faultfold.plans import catalog, oracle

STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(STATEMENTS) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, db, sf_dir, name):
    ours, theirs = compare(spark, db, catalog.QUERIES[name], STATEMENTS[name], sf_dir)
    assert difference(ours, theirs) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
