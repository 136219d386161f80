import pytest

from quizloom.plans.registry import ORACLES, QUERIES
from tests.compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, data, con, name):
    same(QUERIES[name](spark, data), ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    QUERIES[name](spark, data).collect()
