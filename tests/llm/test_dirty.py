"""Every query of the subpackage on empty tables, and on tables with nulls in all columns, repeated rows and clashing extra columns."""

import pytest

from plumbline.llm.registry import collect
from tests.dirty import make

QUERIES = collect()[0]


@pytest.fixture(scope="module", params=[True, False], ids=["empty", "dirty"])
def tables(request, data, tmp_path_factory):
    return make(data, tmp_path_factory.mktemp("t"), request.param), request.param


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    d, empty = tables
    got = QUERIES[name](spark, d).toPandas()
    if empty:
        assert len(got) == 0 or name in ("p2_report", "p4_report")
    elif name.endswith("_found"):
        assert not got.duplicated().any()
