import pytest
from oracle import assert_same

from corpusmill.plans import CATALOG


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if q.sql))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, CATALOG[name], CATALOG[name].sql)


def test_entry_points():
    import __spark_entry__ as entries

    assert set(entries.oracle_sql()) <= set(entries.queries())
