"""The numbered queries that have SQL against it, on the smallest tables."""

import pytest
from oracle import assert_same

from corpusmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_numbered_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
