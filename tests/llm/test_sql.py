"""The registered queries of the operators against their SQL, over the smallest tables."""

import pytest

from scholarmill.llm import queries
from tests.oracle import DATA, compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_its_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), connect(), queries.ORACLE_SQL[name])
