import pytest

from dnstide.plans.oracle import ORACLES
from dnstide.plans.queries import QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 80
