"""Every registered query against its SQL counterpart on the smallest generated tables."""

import pytest

from checks import registry
from checks.compare import compare, open_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


def test_registry_is_consistent():
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.SQL.get(name), SF) is None
