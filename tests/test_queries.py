import pytest

from siftwright import catalog
from tests.compare import assert_same
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_oracle(spark, oracle, name):
    assert_same(catalog.QUERIES[name](spark, SMALL).toPandas(), oracle(catalog.SQL[name]))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
