import pytest

from oracle import connect, differences
from tarja.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


def test_every_query_without_sql_runs(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0
