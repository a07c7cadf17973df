"""A whole run shares its inputs and gives the same data as the registry."""

from tools.oracle_check import rows_of

from dunning.plans.run import ReceivablesRun
from dunning.reports import REPORTS
from dunning.session import written
from dunning.sources import tpch_fixture as fx

SF = "/root/testdata/sf0.001"


def test_run_reports_equal_registry(spark, tmp_path):
    run = ReceivablesRun(fx.statement(spark, SF), fx.payments(spark, SF), fx.PARAMS)
    reports = run.reports()
    assert len(reports) >= 35
    seg = reports["customer_segments"].collect()
    assert {r.cluster for r in seg} <= {0, 1, 2, 3}
    assert sum(r.customers for r in reports["cluster_stats"].collect()) == len(seg)
    for name in ["portfolio_kpis", "pareto", "collection_plan", "weekly_kpis", "credit_limits", "limit_histogram", "scenario_band"]:
        a = reports[name]
        b = REPORTS[name](spark, SF)
        assert rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()]), name
    paths = run.export(str(tmp_path / "out"))
    assert len(paths) == 3
    assert spark.read.option("header", True).csv(paths["customer_credit_limits"]).count() == reports["limit_points"].count()
    assert all("(" not in p.rsplit("/", 1)[0] for p in paths.values())  # one folder each
    plan = reports["top_customers"]._jdf.queryExecution().executedPlan().toString()
    assert "document_no" not in plan  # the written statement is read by column
    before = len(written(spark))
    run.close()
    assert len(written(spark)) < before


def test_run_scored_by_the_model(spark):
    from dataclasses import replace

    run = ReceivablesRun(fx.statement(spark, SF), fx.payments(spark, SF), replace(fx.PARAMS, score_mode="auto"))
    assert run.statement.where("default_probability IS NULL").count() == 0
    assert run.statement.select("default_probability").distinct().count() > 4  # not the four rule values
    reports = run.reports(with_segments=False)
    customers = run.statement.select("customer_code").distinct().count()
    assert reports["credit_limits"].count() == customers
    assert sum(r.customers for r in reports["risk_profiles"].collect()) >= customers
    for name in ("customer_profiles", "scenario_band", "collection_plan", "payments_outside_plan"):
        assert reports[name].count() > 0, name
    run.close()
