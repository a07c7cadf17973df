"""Plan-shape regression tests: the scale properties the design relies on."""

import pytest

from dunning.reports import REPORTS

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
SLOW = {"score_model", "model_holdout", "score_decision", "feature_importance", "customer_segments", "cluster_stats"}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REPORTS) - SLOW))
def test_no_cross_join_or_row_python(spark, name, monkeypatch):
    """Also in the plans that are written on the way to the result."""
    import dunning.session as session

    plans, write = [], session.materialize

    def watched(df):
        plans.append(physical(df))
        return write(df)

    for module in (m for key, m in list(__import__("sys").modules.items()) if key.startswith("dunning.") and hasattr(m, "materialize")):
        monkeypatch.setattr(module, "materialize", watched)
    plans.append(physical(REPORTS[name](spark, SF)))
    for plan in plans:
        for bad in FORBIDDEN:
            assert bad not in plan, f"{name} plans {bad}"
        # only aggregates meet in one partition: partial ones, a few groups', or one row of each range partition
        for below in plan.split("Exchange SinglePartition")[1:]:
            own = below.split("Exchange")[0]
            assert "Aggregate" in own or "partial_" in own, f"{name}: {own}"


def test_statement_scan_is_pruned_and_filtered(spark):
    df = REPORTS["portfolio_kpis"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "In(o_orderstatus, [O,P])" in formatted
    # the customer side only needs the key for the KPIs: name is pruned
    assert "ReadSchema: struct<c_custkey:bigint>" in formatted
    assert "HashAggregate" in plan


def test_top_payments_limit_before_shuffle(spark):
    df = REPORTS["last_payments"](spark, SF)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    head = formatted.split("\n\n")[0]
    assert head.count("WindowGroupLimit") == 2  # partial (before the exchange) and final


def test_month_filter_reaches_the_scan(spark, tmp_path):
    import datetime as dt

    from dunning.plans import collection as CO
    from dunning.sources import tpch_fixture as fx

    fx.payments(spark, SF).write.parquet(str(tmp_path / "p"))
    df = CO.monthly_kpis(spark.read.parquet(str(tmp_path / "p")), dt.date(2001, 7, 30), 100.0)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(payment_date,2001-07-01)" in formatted and "LessThanOrEqual(payment_date,2001-07-31)" in formatted


def test_running_totals_do_not_need_the_package_on_the_workers(tmp_path):
    """In a process of its own: the driver finds the package, workers start in
    another folder without it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import os, sys
sys.path.insert(0, {root!r})
import dunning.reports
from dunning.session import local_session
spark = local_session("2", 4, "elsewhere")
assert spark.range(1).select("id").mapInPandas(
    lambda it: (p.assign(id=[int(__import__("importlib.util").util.find_spec("dunning") is not None)]) for p in it), "id long").first()[0] == 0
print("ROWS", dunning.reports.REPORTS["pareto"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
