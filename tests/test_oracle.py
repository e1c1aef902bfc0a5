"""Every registered core query against its SQL, or at least run, on the smallest tables."""

import pytest

from plumbline.queries.registry import collect
from tests.oracle import connect, same

QUERIES, ORACLE = collect()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        same(got, duck.execute(ORACLE[name]).df())
    else:
        assert len(got.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
