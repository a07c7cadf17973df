"""Corpus queries with SQL must equal DuckDB exactly."""

import pytest

from dunning.llm.oracle import ORACLE
from dunning.llm.queries import QUERIES
from tools.oracle_check import compare, duck

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name):
    ok, n, _, detail, _, _ = compare(spark, duck(D), name, QUERIES[name], ORACLE[name], D)
    assert ok and n, f"{name}: {detail}"
