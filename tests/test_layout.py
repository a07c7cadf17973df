"""Tables in buckets by customer: the same results without exchanges."""

import pytest
from pyspark.sql import functions as F
from tools.oracle_check import rows_of

from dunning import session
from dunning.plans import collection as CO
from dunning.plans import customers as CU
from dunning.plans import limits as LI
from dunning.plans import scenarios as SC
from dunning.plans.prepare import fill_payments, prepare_statement
from dunning.plans.run import ReceivablesRun
from dunning.reports import REPORTS
from dunning.session import bucket_count, materialize_by
from dunning.sources import tpch_fixture as fx
from dunning.sources.layout import largest_share, store_by_customer

SF = "/root/testdata/sf0.001"
KEY = "customer_code"


@pytest.fixture(scope="module")
def tables(spark):
    st = store_by_customer(prepare_statement(fx.statement(spark, SF), fx.AS_OF, "rules"), 8)
    pay = store_by_customer(fx.payments(spark, SF), 8)
    return st, pay, fill_payments(pay)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joins_and_exchanges(plan: str) -> tuple[int, int]:
    """Joins, and exchanges of rows (not of a scalar's partial sums) in a plan."""
    main = plan.split("\nSubqueries")[0].split("Subquery ")[0]
    return main.count("SortMergeJoin") + main.count("ShuffledHashJoin"), main.count("Exchange")


AREAS = {
    "all_customers": lambda st, pay, pf: CU.all_customers(st, pay),
    "customer_profiles": lambda st, pay, pf: CU.customer_profiles(st, pay),
    "payments_only_customers": lambda st, pay, pf: CU.payments_only_customers(st, pf),
    "collection_score": lambda st, pay, pf: CO.collection_score(CO.plan_scope(st, fx.WEEK_START, True), pf).drop("_bal"),
    "scenario_context": lambda st, pay, pf: SC.customer_risk_inputs(st, pf).select(
        KEY, "has_invoices", "current_balance", "current_days", "current_risk"
    ),
}


@pytest.mark.parametrize("name", sorted(AREAS))
def test_joins_by_customer_need_no_exchange(spark, tables, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = AREAS[name](*tables)
        joins, exchanges = joins_and_exchanges(plan_of(df))
        assert joins == 1 and exchanges == 0, plan_of(df)
        want = REPORTS[name](spark, SF)
        assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_limits_join_without_exchange(spark, tables, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, write = [], session.materialize
    monkeypatch.setattr(LI, "materialize", lambda df: plans.append(plan_of(df)) or write(df))
    try:
        st, _, pf = tables
        got = LI.with_explanation(LI.limit_numbers(st, pf, fx.AS_OF))
        assert [joins_and_exchanges(p) for p in plans] == [(1, 0)]
        want = REPORTS["credit_limits"](spark, SF)
        assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compliance_moves_only_the_plan(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        st, _, pf = tables
        plan = CO.collection_plan(st, pf, fx.WEEK_START, 1e9)
        text = plan_of(CO.plan_compliance(plan, pf, fx.WEEK_START, fx.AS_OF))
        paid = text.split("SortMergeJoin")[1]
        assert "Exchange" not in paid[paid.rindex("SortAggregate" if "SortAggregate" in paid else "HashAggregate") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_is_kept_by_written_steps(spark, tables):
    st, pay, pf = tables
    assert bucket_count(st, KEY) == bucket_count(pf, KEY) == 8
    per = materialize_by(pf.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY)
    assert bucket_count(per, KEY) == 8
    assert bucket_count(fx.payments(spark, SF), KEY) is None  # ordinary files
    assert bucket_count(pay.join(fx.payments(spark, SF).select("document_no"), "document_no"), KEY) is None
    assert bucket_count(materialize_by(fx.payments(spark, SF), KEY), KEY) is None


def test_a_hot_customer_leaves_the_table_as_it_is(spark):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(3000)] + [(None, -1)] * 2000
    df = spark.createDataFrame(rows, f"{KEY} long, v int")
    assert 0.3 < largest_share(df) < 0.4
    kept = store_by_customer(df, 64)
    assert bucket_count(kept, KEY) is None and kept.count() == 5000
    few = store_by_customer(df.where("customer_code IS NULL OR customer_code <> 1"), 4)
    assert bucket_count(few, KEY) == 4 and few.where(f"{KEY} IS NULL").count() == 2000
    assert largest_share(df.where("false")) == 0.0


def test_a_run_in_buckets_gives_the_same_reports(spark):
    run = ReceivablesRun(fx.statement(spark, SF), fx.payments(spark, SF), fx.PARAMS, buckets=8)
    assert bucket_count(run.statement, KEY) == 8
    reports = run.reports(with_segments=False)
    for name in ("customer_profiles", "collection_plan", "plan_compliance", "credit_limits", "payment_method_by_status", "payments_outside_plan"):
        want = REPORTS[name](spark, SF)
        assert rows_of(reports[name].columns, map(tuple, reports[name].collect())) == rows_of(want.columns, map(tuple, want.collect())), name
    before = {t.name for t in spark.catalog.listTables()}
    run.close()
    assert {t.name for t in spark.catalog.listTables()} < before
