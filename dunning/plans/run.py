"""All report areas over one pair of tables in one run.

The reference computes its eight areas in a single pass over two in-memory
tables.  ``ReceivablesRun`` is the Spark counterpart: the scored statement is
written once as Parquet in the shared folder (so that each report reads only
its columns), the weekly plan and the credit limits are computed once and
reused by the reports built on them, and ``reports()`` returns every data set
as a lazy DataFrame.  The payments are read where they are.  ``close()``
removes what the run has written.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.params import ReportParams
from dunning.plans import collection as CO
from dunning.plans import concentration as CN
from dunning.plans import customers as CU
from dunning.plans import limits as LI
from dunning.plans import payments as PM
from dunning.plans import portfolio as PO
from dunning.plans import scenarios as SC
from dunning.plans.prepare import fill_payments, prepare_statement
from dunning.session import materialize, remove, written
from dunning.sources import sinks
from dunning.sources.layout import store_by_customer


class ReceivablesRun:
    def __init__(self, statement: DataFrame, payments: DataFrame, params: ReportParams, buckets: int | None = None):
        """``statement`` / ``payments`` are typed tables (e.g. from
        ``ingest.load_receivables``); the statement is classified and scored
        here.  With ``buckets`` both are written once in that many buckets by
        customer, and the areas by customer join them without an exchange."""
        self.params = params
        self.spark = statement.sparkSession
        self._before = set(written(self.spark))
        scored = prepare_statement(statement, params.as_of, params.score_mode)
        self.statement = store_by_customer(scored, buckets) if buckets else materialize(scored)
        self.payments = store_by_customer(payments, buckets) if buckets else payments
        self.payments_filled = fill_payments(self.payments)

    @cached_property
    def plan(self) -> DataFrame:
        p = self.params
        return materialize(
            CO.collection_plan(self.statement, self.payments_filled, p.week_start, p.weekly_goal, p.include_overdue)
        )

    @cached_property
    def limits(self) -> DataFrame:
        return materialize(LI.limit_numbers(self.statement, self.payments_filled, self.params.as_of))

    @cached_property
    def breakdowns(self) -> DataFrame:
        return materialize(PO.breakdowns(self.statement))

    @cached_property
    def filtered_limits(self) -> DataFrame:
        p = self.params
        return LI.filter_limits(self.limits, p.limit_segments, p.limit_low, p.limit_high)

    @cached_property
    def segments(self) -> DataFrame:
        from dunning.plans import ml

        return materialize(ml.segment_customers(CU.customer_rollup(self.statement)))

    def reports(self, with_segments: bool = True) -> dict[str, DataFrame]:
        """Every data set of the eight areas.  ``with_segments`` adds the
        K-means segmentation (one model fit), as the reference always does."""
        st, pay, pf, p = self.statement, self.payments, self.payments_filled, self.params
        parts = PO.reports_of(self.breakdowns)
        out = {
            # executive summary
            "portfolio_kpis": PO.portfolio_kpis(st),
            "monthly_balance": parts["monthly_balance"],
            "balance_by_status": parts["balance_by_status"],
            "payment_method_totals": PM.payment_method_totals(pf),
            "payment_method_summary": PM.payment_method_summary(pf),
            "payment_stats": PM.payment_stats(pay),
            "top_customers": PO.top_customers(st, 10),
            "days_box_overall": PO.days_box(st),
            "payment_method_by_status": PM.payment_method_by_status(pf, st),
            # aging analysis
            "aging_totals": parts["aging_totals"],
            "top_overdue": PO.top_customers(st, 10, min_days=PO.SEVERE_DAYS),
            "balance_by_due_weekday": parts["balance_by_due_weekday"],
            "balance_by_due_month": parts["balance_by_due_month"],
            "pareto": CN.pareto(st),
            "days_box_by_status": PO.days_box(st, "aging_status"),
            "monthly_status_matrix": parts["monthly_status_matrix"],
            # risk prediction
            "risk_profiles": PO.risk_profiles(st),
            "days_box_by_segment": PO.days_box(st, "risk_segment"),
            "segment_action_plan": PO.segment_action_plan(st),
            # customer profile
            "customer_profiles": CU.customer_profiles(st, pay),
            "payments_only_customers": CU.payments_only_customers(st, pf),
            "payment_timeline": CU.payment_timeline(pf),
            "customer_method_totals": PM.payment_method_totals(pf, by="customer_code"),
            "last_payments": CU.last_payments(pf, 5),
            # segmentation input (the clustering itself: ml.segment_customers)
            "customer_rollup": CU.customer_rollup(st),
            # simulator
            "scenario_band": SC.scenario_band(SC.score_scenarios(st, pf)),
            # collection goals
            "week_calendar": CO.week_calendar(self.spark.range(1).select(F.lit(p.as_of).alias("as_of"))),
            "collection_plan": self.plan,
            "plan_compliance": CO.plan_compliance(self.plan, pf, p.week_start, p.as_of),
            "weekly_kpis": CO.weekly_kpis(self.plan, pf, p.week_start, p.weekly_goal, p.as_of),
            "monthly_kpis": CO.monthly_kpis(pf, p.week_start, p.weekly_goal),
            "payments_outside_plan": CO.payments_outside_plan(self.plan, pf, st, p.week_start, p.as_of),
            # credit limits
            "credit_limits": LI.with_explanation(self.limits),
            "limits_summary": LI.limits_summary(self.filtered_limits),
            "limit_histogram": LI.limit_histogram(self.filtered_limits),
            "limit_points": LI.limit_points(self.filtered_limits),
        }
        if with_segments:
            from dunning.plans import ml

            out["customer_segments"] = self.segments
            out["cluster_stats"] = ml.cluster_stats(self.segments)
        return out

    def export(self, folder: str) -> dict[str, str]:
        """The three CSV downloads of the reference: statement, weekly plan,
        filtered limits."""
        stem = sinks.plan_file_stem(CO.week_label(self.params.week_start))
        out = {
            "statement_report": self.statement,
            stem: self.plan,
            "customer_credit_limits": LI.with_explanation(self.filtered_limits),
        }
        return {name: sinks.write_csv(df, f"{folder.rstrip('/')}/{name}") for name, df in out.items()}

    def close(self) -> None:
        """Remove the tables that this run wrote; its reports end with them."""
        remove(self.spark, [p for p in written(self.spark) if p not in self._before])
