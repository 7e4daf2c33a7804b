import pytest
from compare import compare, connect

from tagloom.llm import oracle, queries

QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, sf_dir, name):
    assert compare(spark, duck, QUERIES[name], ORACLE[name], sf_dir) is None
