"""The queries of the llm operators that have SQL, against it."""

import pytest

from labelloom.llm import queries
from tests.compare import connection, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, sf_dir):
    assert not differences(spark, connection(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])
