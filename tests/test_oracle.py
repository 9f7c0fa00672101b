import pytest

from brambling import queries
from tests.oracle import connection, difference

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DIR)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], DIR, con) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DIR).count() >= 0
