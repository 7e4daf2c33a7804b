import pytest
from compare import compare, connect

import __spark_entry__ as entry
from tagloom.plans import oracle, queries

QUERIES = queries.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    assert compare(spark, duck, QUERIES[name], ORACLE[name], sf_dir) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and all(r.title and len(r.description) <= 155 for r in rows)
