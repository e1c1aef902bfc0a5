"""Every query of the subpackage on the smallest tables, against its SQL where there is one."""

import pytest

from plumbline.llm.registry import collect
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
    elif name.endswith("_found"):
        assert not got.duplicated().any()
    else:
        assert len(got.columns)


def test_every_problem_has_its_query():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 8, 9)} | {"p7_ids"} <= set(QUERIES)
