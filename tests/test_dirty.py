import pytest

from plumbline.queries.references import QUERIES
from tests.dirty import make


@pytest.mark.parametrize("empty", [True, False])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_orphans_of_dirty_tables(spark, data, tmp_path, name, empty):
    got = QUERIES[name](spark, make(data, tmp_path, empty)).toPandas()
    assert (len(got) == 0) == empty and not got.duplicated().any()
