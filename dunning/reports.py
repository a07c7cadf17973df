"""Named report queries over the TPC-H derived fixture: ``name -> (spark,
sf_dir) -> DataFrame``.  ``__spark_entry__`` exposes them to the driver and
``bench.py`` times them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions import classify as CL
from dunning.params import ReportParams
from dunning.plans import collection as CO
from dunning.plans import concentration as CN
from dunning.plans import customers as CU
from dunning.plans import limits as LI
from dunning.plans import ml as ML
from dunning.plans import payments as PM
from dunning.plans import portfolio as P
from dunning.plans import scenarios as SC
from dunning.plans.prepare import classify, fill_payments, prepare_statement, score
from dunning.session import materialize, scratch_path
from dunning.sources import ingest as IN
from dunning.sources import sinks as SK
from dunning.sources import tpch_fixture as fx

PARAMS = fx.PARAMS
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """The derived tables for one run, built lazily on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: ReportParams = PARAMS):
        self.spark, self.sf_dir, self.params = spark, sf_dir, params
        self._st = self._pay = None

    @property
    def statement(self) -> DataFrame:
        if self._st is None:
            self._st = prepare_statement(fx.statement(self.spark, self.sf_dir), self.params.as_of, self.params.score_mode)
        return self._st

    @property
    def payments(self) -> DataFrame:
        if self._pay is None:
            self._pay = fx.payments(self.spark, self.sf_dir)
        return self._pay

    @property
    def payments_filled(self) -> DataFrame:
        return fill_payments(self.payments)


def report(name: str):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        REPORTS[name] = run
        return fn

    return deco


# --- executive summary / aging analysis -------------------------------


@report("portfolio_kpis")
def _portfolio_kpis(i: Inputs):
    return P.portfolio_kpis(i.statement)


@report("monthly_balance")
def _monthly_balance(i: Inputs):
    return P.monthly_balance(i.statement)


@report("balance_by_status")
def _balance_by_status(i: Inputs):
    return P.balance_by_status(i.statement)


@report("aging_totals")
def _aging_totals(i: Inputs):
    return P.aging_totals(i.statement)


@report("balance_by_due_weekday")
def _by_weekday(i: Inputs):
    return P.balance_by_due_weekday(i.statement)


@report("balance_by_due_month")
def _by_month(i: Inputs):
    return P.balance_by_due_month(i.statement)


@report("monthly_status_matrix")
def _matrix(i: Inputs):
    return P.monthly_status_matrix(i.statement)


@report("portfolio_breakdowns")
def _breakdowns(i: Inputs):
    return P.breakdowns(i.statement)


@report("risk_profiles")
def _risk_profiles(i: Inputs):
    return P.risk_profiles(i.statement)


@report("top_customers")
def _top_customers(i: Inputs):
    return P.top_customers(i.statement, 10)


@report("top_overdue")
def _top_overdue(i: Inputs):
    return P.top_customers(i.statement, 10, min_days=P.SEVERE_DAYS)


@report("top_customers_certified")
def _top_certified(i: Inputs):
    return P.top_customers_certified(i.statement, 10)


@report("top_overdue_certified")
def _top_overdue_certified(i: Inputs):
    return P.top_customers_certified(i.statement, 10, min_days=P.SEVERE_DAYS)


@report("days_box_overall")
def _box_all(i: Inputs):
    return P.days_box(i.statement)


@report("days_box_by_status")
def _box_status(i: Inputs):
    return P.days_box(i.statement, "aging_status")


@report("days_box_by_segment")
def _box_segment(i: Inputs):
    return P.days_box(i.statement, "risk_segment")


@report("balance_box_by_status")
def _balance_box(i: Inputs):
    return P.balance_box(i.statement, "aging_status")


@report("balance_box_overall")
def _balance_box_all(i: Inputs):
    return P.balance_box(i.statement)


@report("balance_box_sketch")
def _balance_sketch(i: Inputs):
    return P.checked_sketches(i.statement, "balance", ["aging_status"], P.balance_box_sketch(i.statement))


@report("filtered_statement")
def _filtered(i: Inputs):
    p = fx.FILTERED
    return P.filter_statement(i.statement, p.filter_start, p.filter_end, p.filter_statuses)


@report("filter_domain")
def _domain(i: Inputs):
    return P.filter_domain(i.statement)


@report("segment_action_plan")
def _actions(i: Inputs):
    return P.segment_action_plan(i.statement)


@report("fmt_currency")
def _fmt(i: Inputs):
    return P.formatted_amounts(i.statement)


@report("fmt_percent")
def _fmt_percent(i: Inputs):
    return P.formatted_percents(i.statement)


# --- payment methods ---------------------------------------------------------


@report("payment_method_totals")
def _pm_totals(i: Inputs):
    return PM.payment_method_totals(i.payments_filled)


@report("customer_method_totals")
def _pm_customer(i: Inputs):
    return PM.payment_method_totals(i.payments_filled, by="customer_code")


@report("payment_method_summary")
def _pm_summary(i: Inputs):
    return PM.payment_method_summary(i.payments_filled)


@report("payment_stats")
def _pay_stats(i: Inputs):
    return PM.payment_stats(i.payments)


@report("payment_method_by_status")
def _pm_status(i: Inputs):
    return PM.payment_method_by_status(i.payments_filled, i.statement)


# --- customers ---------------------------------------------------------------


@report("all_customers")
def _all_customers(i: Inputs):
    return CU.all_customers(i.statement, i.payments)


@report("customer_profiles")
def _profiles(i: Inputs):
    return CU.customer_profiles(i.statement, i.payments)


@report("payments_only_customers")
def _pay_only(i: Inputs):
    return CU.payments_only_customers(i.statement, i.payments_filled)


@report("last_payments")
def _last_payments(i: Inputs):
    return CU.last_payments(i.payments_filled, 5)


@report("payment_timeline")
def _timeline(i: Inputs):
    return CU.payment_timeline(i.payments_filled)


@report("customer_modal_status")
def _modal(i: Inputs):
    return CU.customer_modal_status(i.statement)


@report("customer_rollup")
def _rollup(i: Inputs):
    return CU.customer_rollup(i.statement)


@report("first_names")
def _first_names(i: Inputs):
    # landed in the order of the document numbers, under names that differ by document
    st = i.statement.withColumn("customer_name", F.concat(F.lit("Name "), F.reverse("document_no")))
    path = scratch_path(i.spark, "in_order")
    st.orderBy(F.col("document_no").cast("long")).write.parquet(path)
    return CU.customer_rollup(IN.with_row_order(i.spark.read.parquet(path)))


@report("payment_history")
def _history(i: Inputs):
    return CU.payment_history(i.payments_filled, i.params.as_of)


# --- concentration, collection plan -----------------------------------------


@report("pareto")
def _pareto(i: Inputs):
    return CN.pareto(i.statement, 80.0)


@report("week_calendar")
def _calendar(i: Inputs):
    # anchored on the data: the day after the latest invoice
    anchor = i.statement.agg(F.date_add(F.max("invoice_date"), 1).alias("as_of"))
    return CO.week_calendar(anchor)


@report("plan_scope_all")
def _scope_all(i: Inputs):
    return CO.plan_scope(i.statement, i.params.week_start, include_overdue=True)


@report("plan_scope_week")
def _scope_week(i: Inputs):
    return CO.plan_scope(i.statement, i.params.week_start, include_overdue=False)


@report("normalized_history")
def _norm_hist(i: Inputs):
    return CO.normalized_history(i.payments_filled)


@report("collection_score")
def _score(i: Inputs):
    p = i.params
    return CO.collection_score(CO.plan_scope(i.statement, p.week_start, p.include_overdue), i.payments_filled).drop("_bal")


def _plan(i: Inputs, week_start=None):
    p = i.params
    return CO.collection_plan(i.statement, i.payments_filled, week_start or p.week_start, p.weekly_goal, p.include_overdue)


@report("collection_plan")
def _collection_plan(i: Inputs):
    return _plan(i)


@report("collection_goal")
def _collection_goal(i: Inputs):
    p = i.params
    return CO.collection_goal(i.statement, i.payments_filled, p.week_start, p.weekly_goal, p.include_overdue)


@report("week_payments")
def _week_payments(i: Inputs):
    return CO.week_payments(i.payments_filled, i.params.week_start)


@report("plan_compliance")
def _compliance(i: Inputs):
    p = i.params
    return CO.plan_compliance(_plan(i), i.payments_filled, p.week_start, p.as_of)


@report("plan_compliance_future")
def _compliance_future(i: Inputs):
    p = i.params
    return CO.plan_compliance(_plan(i, fx.FUTURE_WEEK_START), i.payments_filled, fx.FUTURE_WEEK_START, p.as_of)


@report("weekly_kpis")
def _weekly(i: Inputs):
    p = i.params
    return CO.weekly_kpis(_plan(i), i.payments_filled, p.week_start, p.weekly_goal, p.as_of)


@report("monthly_kpis")
def _monthly(i: Inputs):
    p = i.params
    return CO.monthly_kpis(i.payments_filled, p.week_start, p.weekly_goal)


@report("payments_outside_plan")
def _outside(i: Inputs):
    p = i.params
    return CO.payments_outside_plan(_plan(i), i.payments_filled, i.statement, p.week_start, p.as_of)


# --- credit limits -----------------------------------------------------------


def _limits(i: Inputs):
    return LI.limit_numbers(i.statement, i.payments_filled, i.params.as_of)


@report("credit_limits")
def _credit_limits(i: Inputs):
    return LI.with_explanation(_limits(i))


@report("limit_explanation")
def _explanation(i: Inputs):
    return LI.with_explanation(_limits(i)).select("customer_code", "customer_name", "explanation")


@report("limits_filtered")
def _limits_filtered(i: Inputs):
    p = fx.FILTERED
    return LI.with_explanation(LI.filter_limits(_limits(i), p.limit_segments, p.limit_low, p.limit_high))


@report("limits_domain")
def _limits_domain(i: Inputs):
    return LI.limits_domain(_limits(i))


@report("limits_summary")
def _limits_summary(i: Inputs):
    return LI.limits_summary(_limits(i))


@report("limit_histogram")
def _limit_histogram(i: Inputs):
    return LI.limit_histogram(_limits(i), 20)


@report("limits_box_by_segment")
def _limits_box(i: Inputs):
    return LI.limits_box(_limits(i))


@report("limits_box_sketch")
def _limits_box_sketch(i: Inputs):
    limits = materialize(_limits(i))
    return P.checked_sketches(limits, "credit_limit", ["risk_segment"], LI.limits_box_sketch(limits))


@report("limit_points")
def _limit_points(i: Inputs):
    return LI.limit_points(_limits(i))


# --- what-if scenarios -------------------------------------------------------


@report("scenario_risk")
def _scenario_risk(i: Inputs):
    return SC.score_scenarios(i.statement, i.payments_filled)


@report("scenario_context")
def _scenario_context(i: Inputs):
    inputs = SC.customer_risk_inputs(i.statement, i.payments_filled)
    return inputs.select("customer_code", "has_invoices", "current_balance", "current_days", "current_risk")


@report("scenario_band")
def _scenario_band(i: Inputs):
    return SC.scenario_band(SC.score_scenarios(i.statement, i.payments_filled))


# --- classification steps and the risk model ---------------------------------


@report("days_past_due")
def _days(i: Inputs):
    return i.statement.select("document_no", "due_date", "days_past_due")


@report("aging_status")
def _status(i: Inputs):
    return i.statement.select(
        "document_no", "days_past_due", "aging_status", "aging_0_30", "aging_31_60", "aging_61_90", "aging_91_120", "aging_over_120"
    )


@report("score_rules")
def _score_rules(i: Inputs):
    return i.statement.select("document_no", "days_past_due", "default_probability")


@report("risk_segment")
def _risk_segment(i: Inputs):
    p = F.col("default_probability")
    return i.statement.select(
        "document_no",
        "default_probability",
        "risk_segment",
        CL.risk_segment(p, include_lowest=True).alias("risk_segment_inclusive"),
        CL.segment_rank(F.col("risk_segment")).alias("segment_rank"),
    )


@report("score_fallback")
def _fallback(i: Inputs):
    # early enough that no invoice is over 60 days late: one class, nothing to train on
    st = score(classify(fx.statement(i.spark, i.sf_dir), fx.ONE_CLASS_AS_OF), mode="auto")
    return st.select("document_no", "default_probability", "risk_segment")


@report("training_frame")
def _training(i: Inputs):
    return ML.training_frame(i.statement)


@report("score_model")
def _score_model(i: Inputs):
    st = i.statement
    model = ML.fit_risk_model(st)
    return ML.score_model(st, model).select("document_no", "days_past_due", "default_probability", "risk_segment")


@report("score_decision")
def _score_decision(i: Inputs):
    st = i.statement
    scored = ML.score_model(st, ML.fit_risk_model(st))
    return scored.select("document_no", (F.col("default_probability") > 0.5).alias("high_risk"))


@report("score_evaluation")
def _score_evaluation(i: Inputs):
    return ML.evaluate(ML.labelled(i.statement), "default_probability", "label")


@report("score_calibration")
def _score_calibration(i: Inputs):
    return ML.calibration(ML.labelled(i.statement), "default_probability", "label")


@report("model_holdout")
def _model_holdout(i: Inputs):
    return ML.model_holdout(i.statement)[0]


@report("feature_importance")
def _importance(i: Inputs):
    return ML.feature_importance(ML.fit_risk_model(i.statement))


@report("imputed_rollup")
def _imputed(i: Inputs):
    return ML.imputed_rollup(CU.customer_rollup(i.statement))


@report("standardized_rollup")
def _standardized(i: Inputs):
    return ML.standardized_rollup(CU.customer_rollup(i.statement))


@report("segment_points")
def _segment_points(i: Inputs):
    return ML.segment_points(CU.customer_rollup(i.statement))


@report("customer_segments")
def _segments(i: Inputs):
    return ML.segment_customers(CU.customer_rollup(i.statement))


@report("cluster_stats")
def _cluster_stats(i: Inputs):
    return ML.cluster_stats(ML.segment_customers(CU.customer_rollup(i.statement)))


# --- sources and sinks ---------------------------------------------------------


def _landed(i: Inputs, raw: DataFrame, name: str) -> str:
    """Land a raw text table as CSV part files in the shared scratch folder."""
    return SK.write_csv(raw, scratch_path(i.spark, name))


@report("load_statement")
def _load_statement(i: Inputs):
    path = _landed(i, fx.statement_raw(i.spark, i.sf_dir), "statement_raw")
    cols = [c.split(" AS ")[-1] for c in fx.STATEMENT_RAW_COLUMNS]
    return IN.require_non_empty(IN.read_receivables(i.spark, path, "csv", cols), "statement")


@report("load_payments")
def _load_payments(i: Inputs):
    path = _landed(i, fx.payments_raw(i.spark, i.sf_dir), "payments_raw")
    cols = [c.split(" AS ")[-1] for c in fx.PAYMENTS_RAW_COLUMNS]
    return IN.require_non_empty(IN.read_receivables(i.spark, path, "csv", cols), "payments")


@report("load_statement_ranges")
def _load_ranges(i: Inputs):
    # one file with line breaks in every name, read in byte ranges; one task writes it, others join
    raw = fx.statement_raw(i.spark, i.sf_dir).withColumn("customer_name", F.concat("customer_name", F.lit("\n\""), "document_no", F.lit('"')))
    return IN.read_csv_ranges(i.spark, SK.write_csv(raw.repartition(1), scratch_path(i.spark, "statement_lines")))


def _accounts(i: Inputs) -> dict[str, IN.Accounted]:
    statement = IN.clean_accounted(fx.statement_raw(i.spark, i.sf_dir), IN.clean_statement, IN.STATEMENT_COERCED, ["document_no"])
    payments = IN.clean_accounted(
        fx.payments_raw(i.spark, i.sf_dir).withColumn("_line", F.col("line_no")), IN.clean_payments, IN.PAYMENT_COERCED, ["document_no", "_line"]
    )
    return {"statement": statement, "payments": payments}


@report("coercion_account")
def _coercion_account(i: Inputs):
    a, b = (x.counts.withColumn("table_name", F.lit(name)) for name, x in _accounts(i).items())
    return a.union(b)


@report("rejected_cells")
def _rejected_cells(i: Inputs):
    a, b = _accounts(i).values()
    line = F.col("_line").alias("line_no")
    return a.rejects.select("document_no", F.lit(None).cast("string").alias("line_no"), "column_name", "cell").union(
        b.rejects.select("document_no", line, "column_name", "cell")
    )


@report("clean_statement")
def _clean_statement(i: Inputs):
    return IN.clean_statement(fx.statement_raw(i.spark, i.sf_dir))


@report("clean_payments")
def _clean_payments(i: Inputs):
    return IN.clean_payments(fx.payments_raw(i.spark, i.sf_dir))


def _round_trip(i: Inputs, df: DataFrame, name: str) -> DataFrame:
    path = SK.write_csv(df, scratch_path(i.spark, name))
    return SK.read_csv(i.spark, path, df.schema)


@report("export_statement")
def _export_statement(i: Inputs):
    return _round_trip(i, i.statement, "statement_report")


@report("export_plan")
def _export_plan(i: Inputs):
    stem = SK.plan_file_stem(CO.week_label(i.params.week_start))
    return _round_trip(i, _plan(i), stem)


@report("export_limits")
def _export_limits(i: Inputs):
    return _round_trip(i, LI.with_explanation(_limits(i)), "customer_credit_limits")
