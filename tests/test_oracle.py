"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest
from oracle import DATA, compare

from skeinlake import plans

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test data")
_queries, _sql = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(_sql))
def test_query_equals_sql(spark, name):
    compare(spark, name, _queries[name], _sql[name])


def test_sql_has_queries():
    assert set(_sql) <= set(_queries)


def test_search_struct_with_zero_vectors(spark):
    """At this scale a post has a structural vector of length 0."""
    compare(spark, "search_struct", _queries["search_struct"], _sql["search_struct"], "sf0.01")
