"""Every query of the catalogue against its SQL."""

import pytest

from learntrace.plans import catalogue
from tests.conftest import SF
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_queries_without_sql_are_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"self_supervised_prototypes"}
    assert not set(catalogue.ORACLES) - set(catalogue.QUERIES)
