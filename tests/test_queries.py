"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from labelloom.plans import registry
from tests.compare import connection, differences


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf, name):
    if name in registry.ORACLE_SQL:
        assert not differences(spark, con, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])
    else:
        assert registry.QUERIES[name](spark, sf).count() > 0
