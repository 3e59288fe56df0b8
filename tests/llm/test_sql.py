"""The corpus queries that have SQL, against DuckDB."""

import pytest

from learntrace.llm import queries
from tests.conftest import SF
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
