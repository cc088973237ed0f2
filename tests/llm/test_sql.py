"""The registered queries that SQL can express, against their SQL over whole tables."""

import pytest
from compare import compare, connect, difference

from faultfold.llm import oracle, queries

STATEMENTS = oracle.statements()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows(spark, sf_dir, name):
    ours, theirs = compare(spark, connect(sf_dir), queries.QUERIES[name], STATEMENTS[name], sf_dir)
    assert difference(ours, theirs) is None
