"""Every report with oracle SQL must equal DuckDB exactly (sf0.001), the
same check the driver runs at sf0.01."""

import pytest

from dunning.reports import REPORTS
from oracle.sql import ORACLE
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"
# no SQL gives the trees' probabilities or the cluster ids
SLOW = {"model_holdout", "score_model", "feature_importance", "customer_segments", "cluster_stats"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_report_matches_duckdb(spark, duck_small, name):
    ok, n, _, detail, _, _ = compare(spark, duck_small, name, REPORTS[name], ORACLE[name], SF)
    assert ok, f"{name}: {detail}"


def test_every_oracle_has_a_report():
    assert set(ORACLE) <= set(REPORTS)


def test_rows_only_reports_are_the_non_sql_ones():
    assert set(REPORTS) - set(ORACLE) == SLOW


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["total_balance", "overdue_balance", "overdue_customers", "overdue_ratio", "dso_days"]
