import pytest

from tests.conftest import SMALL
from tests.oracle import same
from trellis import catalog


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_its_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], SMALL)


def test_entry_needs_no_llm(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["row_cls", "n"]
