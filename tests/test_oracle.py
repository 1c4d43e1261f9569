"""Every query against its DuckDB SQL on the smallest tables."""

import pytest
from oracle_check import connect, differences

from filecover.plans.oracle import ORACLE
from filecover.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query = QUERIES[name]
    assert differences(spark, duck, name, query, ORACLE[name], SF_DIR) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["folder", "files", "bytes", "sample", "more"]
