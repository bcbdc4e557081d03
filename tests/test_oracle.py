"""Every registered query against its DuckDB counterpart at the smallest scale."""
import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["repo_id", "rank", "path"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert check.compare(spark, check.connect(SF), SF, name, QUERIES[name], SQL.get(name)) is None
