"""Hand-made rows for what the fixtures cannot reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from dunning.functions import classify as C
from dunning.functions import labels as L
from dunning.functions import text as T
from dunning.operators.distribution import exact_median, histogram
from dunning.operators.modal import label_counts, modal_by_rank, modal_label
from dunning.operators.running import running_total, select_to_goal
from dunning.plans import collection as CO
from dunning.plans import customers as CU
from dunning.plans import portfolio as PO
from dunning.plans import scenarios as SC
from dunning.plans.prepare import classify, fill_payments, score_rules
from dunning.sources import ingest as IN

AS_OF = dt.date(2001, 8, 2)

ST_SCHEMA = StructType(
    [
        StructField("customer_code", LongType()),
        StructField("customer_name", StringType()),
        StructField("document_no", StringType()),
        StructField("invoice_date", DateType()),
        StructField("due_date", DateType()),
        StructField("initial_amount", DoubleType()),
        StructField("balance", DoubleType()),
    ]
)
PAY_SCHEMA = StructType(
    [
        StructField("customer_code", LongType()),
        StructField("customer_name", StringType()),
        StructField("document_no", StringType()),
        StructField("line_no", IntegerType()),
        StructField("payment_date", DateType()),
        StructField("paid_amount", DoubleType()),
        StructField("cash", DoubleType()),
        StructField("cheque", DoubleType()),
        StructField("card", DoubleType()),
        StructField("transfer", DoubleType()),
    ]
)


def d(days_before_as_of):
    return AS_OF - dt.timedelta(days=days_before_as_of)


def statement(spark, rows):
    return score_rules(classify(spark.createDataFrame(rows, ST_SCHEMA), AS_OF))


# --- classification boundaries ------------------------------------------------


@pytest.mark.parametrize(
    "days,status,p",
    [
        (-5, L.STATUS_CURRENT, 0.1),
        (15, L.STATUS_CURRENT, 0.1),
        (16, L.STATUS_CURRENT, 0.3),
        (30, L.STATUS_CURRENT, 0.3),
        (31, L.STATUS_EARLY, 0.5),
        (60, L.STATUS_EARLY, 0.5),
        (61, L.STATUS_MODERATE, 0.85),
        (90, L.STATUS_MODERATE, 0.85),
        (91, L.STATUS_HIGH, 0.85),
        (120, L.STATUS_HIGH, 0.85),
        (121, L.STATUS_SEVERE, 0.85),
        (None, L.STATUS_CURRENT, 0.1),
    ],
)
def test_status_and_rule_boundaries(spark, days, status, p):
    due = None if days is None else d(days)
    st = statement(spark, [(1, "a", "1", d(200), due, 10.0, 10.0)])
    row = st.first()
    assert row.days_past_due == days
    assert row.aging_status == status
    assert row.default_probability == p


def test_segment_boundaries_including_high(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 0.3, 0.30001, 0.6, 0.7, 0.8, 0.81, 1.0, 1.2, -0.1, None]], "p double")
    got = df.select(
        C.risk_segment(F.col("p"), include_lowest=True).alias("a"), C.risk_segment(F.col("p"), include_lowest=False).alias("b")
    ).collect()
    a = [r.a for r in got]
    b = [r.b for r in got]
    assert a == [
        L.SEGMENT_LOW, L.SEGMENT_LOW, L.SEGMENT_LOW, L.SEGMENT_MODERATE, L.SEGMENT_MODERATE, L.SEGMENT_HIGH,
        L.SEGMENT_HIGH, L.SEGMENT_EXTREME, L.SEGMENT_EXTREME, None, None, None,
    ]
    assert b[0] is None and b[1:] == a[1:]


def test_aging_buckets_hold_balance_of_own_class(spark):
    st = statement(spark, [(1, "a", "1", d(300), d(200), 5.0, 7.5), (1, "a", "2", d(10), d(0), 5.0, 2.5)])
    rows = {r.document_no: r for r in st.collect()}
    assert rows["1"].aging_over_120 == 7.5 and rows["1"].aging_0_30 == 0.0
    assert rows["2"].aging_0_30 == 2.5 and rows["2"].aging_over_120 == 0.0


# --- KPIs, nulls, empty groups ------------------------------------------------------


def test_kpis_non_positive_total_gives_zero_ratios(spark):
    st = statement(spark, [(1, "a", "1", d(100), d(90), 5.0, -10.0), (2, "b", "2", d(100), d(90), 5.0, 10.0)])
    r = PO.portfolio_kpis(st).first()
    assert r.total_balance == 0.0 and r.overdue_ratio == 0.0 and r.dso_days == 0.0
    assert r.overdue_customers == 2


def test_dso_skips_missing_days_in_numerator_only(spark):
    st = statement(spark, [(1, "a", "1", d(100), d(40), 5.0, 100.0), (2, "b", "2", d(100), None, 5.0, 100.0)])
    r = PO.portfolio_kpis(st).first()
    assert r.total_balance == 200.0
    assert r.dso_days == pytest.approx(40 * 100 / 200)


def test_risk_profiles_emit_empty_segments(spark):
    st = statement(spark, [(1, "a", "1", d(100), d(5), 5.0, 10.0)])
    rows = {r.risk_segment: r for r in PO.risk_profiles(st).collect()}
    assert set(rows) == set(L.SEGMENTS)
    assert rows[L.SEGMENT_HIGH].customers == 0 and rows[L.SEGMENT_HIGH].balance == 0.0
    assert rows[L.SEGMENT_HIGH].avg_days is None


def test_null_keys_are_dropped_from_groupings(spark):
    st = statement(spark, [(None, "x", "1", d(100), d(5), 5.0, 10.0), (1, None, "2", d(100), d(5), 5.0, 10.0)])
    assert CU.customer_rollup(st).count() == 1
    assert PO.top_customers(st).count() == 1


def test_month_of_missing_invoice_date_is_nat(spark):
    st = statement(spark, [(1, "a", "1", None, d(5), 5.0, 10.0)])
    assert PO.monthly_balance(st).first().invoice_month == "NaT"


# --- modal value -------------------------------------------------------------------


def test_modal_tie_goes_to_least_severe(spark):
    st = statement(
        spark,
        [
            (1, "a", "1", d(300), d(200), 1.0, 1.0),
            (1, "a", "2", d(10), d(0), 1.0, 1.0),
            (2, "b", "3", d(300), d(200), 1.0, 1.0),
            (2, "b", "4", d(300), d(200), 1.0, 1.0),
            (2, "b", "5", d(10), d(0), 1.0, 1.0),
        ],
    )
    generic = {r.customer_code: r.modal_status for r in CU.customer_modal_status(st).collect()}
    single = {r.customer_code: r.modal_status for r in CU.customer_rollup(st).collect()}
    assert generic == single == {1: L.STATUS_CURRENT, 2: L.STATUS_SEVERE}


def test_modal_label_matches_generic_on_random_data(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 30), rnd.choice(L.STATUSES)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, s string")
    s = F.col("s")
    a = {r.k: r.m for r in modal_by_rank(df, ["k"], s, C.status_rank(s), "m").collect()}
    b = {
        r.k: r.m
        for r in df.groupBy("k").agg(*label_counts(s, L.STATUSES, "_c")).select("k", modal_label(L.STATUSES, "_c").alias("m")).collect()
    }
    assert a == b


# --- running totals and the goal cut ---------------------------------------------------


def _brute_running(rows, key):
    ordered = sorted(rows, key=key)
    out, acc = {}, 0
    for pos, r in enumerate(ordered, start=1):
        acc += r[1]
        out[r[0]] = (acc, pos)
    return out


def test_running_total_matches_plain_window_with_hot_ties_and_negatives(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(6000):
        # a third of all rows share one value: range bounds must split them by the tie-break
        v = 500 if i % 3 == 0 else rnd.randint(-1000, 100000)
        rows.append((f"n{i:05d}", v))
    df = spark.createDataFrame(rows, "name string, v long")
    got = running_total(df, [F.desc("v"), F.asc("name")], F.col("v"), "cum", position="pos", num_partitions=16)
    res = {r.name: (r.cum, r.pos) for r in got.collect()}
    want = _brute_running(rows, key=lambda r: (-r[1], r[0]))
    assert res == want
    plain = df.withColumn(
        "cum", F.sum("v").over(Window.orderBy(F.desc("v"), F.asc("name")).rowsBetween(Window.unboundedPreceding, 0))
    )
    assert {r.name: r.cum for r in plain.collect()} == {k: v[0] for k, v in want.items()}


def test_running_total_hot_value_is_split_across_partitions(spark):
    rows = [(f"n{i:05d}", 7 if i % 3 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, v long")
    ranged = df.repartitionByRange(8, F.desc("v"), F.asc("name"))
    sizes = ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 3000 * 0.34  # the 2/3 hot value is spread out


def _plan_frame(spark, balances):
    rows = [(i + 1, float(b), len(balances) - i) for i, b in enumerate(balances)]
    return spark.createDataFrame(rows, "customer_code long, balance double, score long")


@pytest.mark.parametrize(
    "balances,goal",
    [
        ([100, 200, 300, 400], 250),
        ([100, 200, 300, 400], 300),
        ([100, -500, 900, 50, 10], 450),
        ([100, 200], 10_000),
        ([100, 200], 0),
        ([-5, -5], 1),
    ],
)
def test_select_to_goal_equals_reference_walk(spark, balances, goal):
    plan = _plan_frame(spark, balances)
    ranked = running_total(plan, [F.desc("score")], (F.col("balance") * 100).cast("long"), "_c", position="position")
    ranked = ranked.withColumn("cum_balance", F.col("_c") / 100.0)
    got = sorted(r.customer_code for r in select_to_goal(ranked, goal, "cum_balance", "position").collect())
    # the reference loop
    picked, acc = [], 0.0
    for i, b in enumerate(balances):
        if acc >= goal:
            break
        picked.append(i + 1)
        acc += b
    assert got == picked


# --- distributions ----------------------------------------------------------------------


def test_exact_median_even_and_odd(spark):
    for vals in ([3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = spark.range(1).select(exact_median(df, F.col("x")).alias("m")).first().m
        s = sorted(vals)
        n = len(s)
        want = s[n // 2] if n % 2 else s[n // 2 - 1] + 0.5 * (s[n // 2] - s[n // 2 - 1])
        assert got == want


def test_histogram_all_equal_and_max_in_last_bin(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    rows = histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0]
    df = spark.createDataFrame([(0.0,), (10.0,), (2.5,)], "x double")
    rows = histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 0, 1]


def test_box_summary_outliers(spark):
    st = statement(spark, [(1, "a", str(i), d(300), d(v), 1.0, 1.0) for i, v in enumerate([1, 2, 3, 4, 100])])
    r = PO.days_box(st).first()
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert r.outliers == 1


# --- payments, scenarios, calendar ---------------------------------------------------------------


def test_single_payment_std_is_zero_and_history_default(spark):
    st = statement(spark, [(1, "a", "1", d(100), d(5), 1000.0, 1000.0)])
    pay = fill_payments(spark.createDataFrame([(1, "a", "9", 1, d(3), 500.0, 500.0, 0.0, 0.0, 0.0), (2, "b", "8", 1, d(3), None, 0.0, 0.0, 0.0, 0.0)], PAY_SCHEMA))
    rows = {r.customer_code: r for r in SC.customer_risk_inputs(st, pay).collect()}
    # one payment: std 0 -> history = trunc(0.1 + 1 + 30/30) = 2; type New
    assert rows[1].history_score == 2 and rows[1].derived_type == "New"
    assert rows[1].risk_base == pytest.approx(0.1)
    # payments only, paid filled to 0: base = mean paid = 0
    assert rows[2].base_amount == 0.0 and rows[2].current_risk == 0.3


def test_scenarios_emit_customers_times_grid(spark):
    st = statement(spark, [(1, "a", "1", d(100), d(5), 1000.0, 1000.0)])
    pay = fill_payments(spark.createDataFrame([(3, "c", "9", 1, d(3), 50.0, 50.0, 0.0, 0.0, 0.0)], PAY_SCHEMA))
    out = SC.score_scenarios(st, pay)
    assert out.count() == 2 * len(SC.DEFAULT_GRID)
    assert out.where(F.col("simulated_risk") > 0.99).count() == 0


@pytest.mark.parametrize("as_of,n", [(dt.date(2001, 8, 2), 9), (dt.date(2024, 12, 30), 10)])
def test_week_calendar_monday_anchor(spark, as_of, n):
    anchor = spark.createDataFrame([(as_of,)], "as_of date")
    rows = CO.week_calendar(anchor).orderBy("week_start").collect()
    assert len(rows) == n
    assert all(r.week_start.weekday() == 0 for r in rows)
    # ISO week of the Monday, calendar year of the Monday
    r = [x for x in rows if x.week_start == dt.date(2024, 12, 30)]
    if r:
        assert r[0].iso_week == 1 and r[0].year == 2024
    assert rows[0].label == CO.week_label(rows[0].week_start)


def test_future_week_compliance_is_planned(spark):
    st = statement(spark, [(1, "a", "1", d(10), d(0), 1000.0, 1000.0)])
    pay = fill_payments(spark.createDataFrame([(1, "a", "9", 1, d(1), 50.0, 50.0, 0.0, 0.0, 0.0)], PAY_SCHEMA))
    week = dt.date(2001, 8, 6)
    plan = CO.collection_plan(st, pay, week, 1e9)
    out = CO.plan_compliance(plan, pay, week, AS_OF).collect()
    assert [(r.paid_in_week, r.compliance) for r in out] == [(0.0, L.PLAN_FUTURE)]
    k = CO.weekly_kpis(plan, pay, week, 1e9, AS_OF).first()
    assert k.collected == 0.0 and k.compliance_ratio == 0.0


# --- text and ingest ------------------------------------------------------------------------------


def test_currency_and_percent_text(spark):
    df = spark.createDataFrame([(1234.5,), (1000.0,), (-5.5,), (None,), (2.5,)], "x double")
    got = [r.t for r in df.select(T.fmt_currency(F.col("x")).alias("t")).collect()]
    assert got == ["$1,234.50", "$1,000", "$-5.50", "N/A", "$2.50"]
    got = [r.t for r in df.select(T.fmt_percent(F.col("x") / 10000).alias("t")).collect()]
    assert got == ["12.3%", "10.0%", "-0.1%", "N/A", "0.0%"]
    got = [r.t for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(T.fixed(F.col("x"), 0).alias("t")).collect()]
    assert got == [f"{2.5:.0f}", f"{3.5:.0f}"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("1,234.50", 1234.5),
        (" 12 ", 12.0),
        ("1e3", 1000.0),
        ("+5", 5.0),
        (".5", 0.5),
        ("nan", None),
        ("N/A", None),
        ("$5", None),
        ("(5)", None),
        ("0x10", None),
        ("1d", None),
        ("1f", None),
        ("", None),
        (None, None),
        ("inf", None),
        ("-1e17", None),
        ("1e15", None),
        ("999999999999999", 999999999999999.0),
    ],
)
def test_clean_amount_accepts_what_pandas_accepts(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(IN.clean_amount(F.col("s")).alias("v")).first().v
    assert got == want


def test_require_non_empty(spark):
    with pytest.raises(ValueError):
        IN.require_non_empty(spark.createDataFrame([], "a string"), "statement")


def test_csv_round_trip(spark, tmp_path):
    from dunning.sources import sinks

    st = statement(spark, [(1, "a, b", "1", d(100), None, 1.25, 2.5)])
    path = sinks.write_csv(st, str(tmp_path / "x"))
    back = sinks.read_csv(spark, path, st.schema)
    assert back.collect() == st.collect()
    assert sinks.plan_file_stem("Week 31 (30/07/2001 - 05/08/2001)") == "collection_plan_Week_31_(30-07-2001_-_05-08-2001)"


def test_csv_round_trip_keeps_every_text(spark, tmp_path):
    from dunning.sources import sinks

    texts = ['say "hi"', "a, b", "line\nbreak", " lead", "trail ", "", None, '"', "\\", '\\"', "'", "été"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(2)
    back = sinks.read_csv(spark, sinks.write_csv(df, str(tmp_path / "t")), df.schema)
    assert [r.t for r in back.orderBy("i").collect()] == texts


def test_pandas_csv_loads_exactly(spark, tmp_path):
    import pandas as pd

    names = ['A "B" C, Inc', "two\nlines", "plain", " lead"]
    frame = pd.DataFrame({"customer_name": names, "balance": ["1,000.50", "10", "45.0", "-3"], "days_past_due": ["45.0", "x", "61", "1.5"]})
    frame.to_csv(tmp_path / "a.csv", index=False)
    raw = IN.read_receivables(spark, str(tmp_path / "a.csv"), columns=IN.STATEMENT_TEXT_COLUMNS)
    assert raw.columns == ["customer_name", "days_past_due", "balance"]
    got = {r.customer_name: (r.balance, r.days_past_due) for r in IN.clean_statement(raw).collect()}
    assert got == dict(zip(names, [(1000.5, 45), (10.0, None), (45.0, 61), (-3.0, None)], strict=True))


@pytest.mark.parametrize(
    "text, want",
    [
        ("2001-01-02", dt.date(2001, 1, 2)),
        (" 2001-01-02 00:00:00 ", dt.date(2001, 1, 2)),
        ("2001-01-02 23:59", dt.date(2001, 1, 2)),
        ("2001-01-02T10:11:12", dt.date(2001, 1, 2)),
        ("2001-01-02 10:11:12.123456", dt.date(2001, 1, 2)),
        ("2001-13-02", None),
        ("bad-date", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_with_and_without_time(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(IN.parse_date(F.col("s")).alias("d")).first().d == want


def test_amounts_out_of_range_count_as_missing(spark):
    from dunning.functions.money import money_mean, money_total

    df = spark.createDataFrame([(1.5,), (float("inf"),), (float("nan"),), (1e17,), (2.5,)], "x double")
    assert tuple(df.agg(money_total(F.col("x"))).first()) == (4.0,)
    assert df.where("x < 100").agg(money_mean(F.col("x"))).first()[0] == 2.0


def test_spreads_of_very_many_and_very_large_values(spark):
    from decimal import Decimal

    from dunning.functions.money import sample_std, spread_and_centre

    n, s1, s2 = 2_000_000_000, 10**20, 3 * 10**31
    std, centre = spread_and_centre(n, s1, s2, 0, ddof=0)
    assert std == pytest.approx((s2 / n - (s1 / n) ** 2) ** 0.5) and centre == s1 / n
    df = spark.createDataFrame([(n, Decimal(s1), Decimal(s2))], "n long, s1 decimal(38,0), s2 decimal(38,0)")
    assert df.select(sample_std(F.col("n"), F.col("s1"), F.col("s2"), 0)).first()[0] == pytest.approx(std, rel=1e-6)


def test_default_parameters_drop_no_row(spark):
    from dunning.params import ReportParams
    from dunning.plans import limits as LI
    from dunning.reports import Inputs

    p = ReportParams(as_of=AS_OF, week_start=dt.date(2001, 7, 30))
    assert p.score_mode == "auto"
    i = Inputs(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert i.statement.count() == orders.where("o_orderstatus IN ('O', 'P')").count()
    assert i.payments.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert PO.filter_statement(i.statement, p.filter_start, p.filter_end, p.filter_statuses).count() == i.statement.count()
    limits = LI.limit_numbers(i.statement, i.payments_filled, AS_OF)
    kept = LI.filter_limits(limits, p.limit_segments, p.limit_low, p.limit_high)
    assert kept.count() == limits.count() == i.statement.select("customer_code").distinct().count()


def test_text_cells_pass_through_formats(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,), ("3",)], "s string")
    got = df.select(T.fmt_currency(F.col("s"), text=True).alias("c"), T.fmt_percent(F.col("s"), text=True).alias("p")).collect()
    assert [tuple(r) for r in got] == [("$12.50", "1250.0%"), ("abc", "abc"), ("N/A", "N/A"), ("$3", "300.0%")]


def test_load_receivables_end_to_end(spark, tmp_path):
    from dunning.sources import sinks
    from dunning.sources import tpch_fixture as fx

    sf = "/root/testdata/sf0.001"
    raw_st = fx.statement_raw(spark, sf).withColumn("fiscal_no", F.lit("B01"))
    raw_pay = fx.payments_raw(spark, sf)
    sp = sinks.write_csv(raw_st.select(*[c for c in IN.STATEMENT_TEXT_COLUMNS if c in raw_st.columns]), str(tmp_path / "st"))
    pp = sinks.write_csv(raw_pay, str(tmp_path / "pay"))
    st, pay = IN.load_receivables(spark, sp, pp)
    assert st.count() == raw_st.count() and pay.count() == raw_pay.count()
    types = dict(st.dtypes)
    assert types["invoice_date"] == "date" and types["balance"] == "double"
    assert "days_past_due" not in types  # optional column: absent here, derived later by classify
    assert st.where(F.col("balance").isNull()).count() == raw_st.where(F.col("balance").isin("N/A", "nan")).count()
    empty = sinks.write_csv(raw_pay.limit(0), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        IN.load_receivables(spark, sp, empty)


def test_median_of_all_missing_column_raises(spark):
    from dunning.plans.ml import impute_median

    df = spark.createDataFrame([(1, None), (2, None)], "customer_code long, avg_days double")
    with pytest.raises(ValueError):
        impute_median(df, ["avg_days"])


def test_approx_distinct_opt_in_is_close(spark):
    from dunning.plans import payments as PM
    from dunning.reports import Inputs

    i = Inputs(spark, "/root/testdata/sf0.01")
    exact = PO.portfolio_kpis(i.statement).first().overdue_customers
    approx = PO.portfolio_kpis(i.statement, approx_distinct=True).first().overdue_customers
    assert abs(approx - exact) <= max(3, 0.03 * exact)
    e = PM.payment_stats(i.payments).first().customers
    a = PM.payment_stats(i.payments, approx_distinct=True).first().customers
    assert abs(a - e) <= max(3, 0.03 * e)


def test_scenario_scores_do_not_overflow_for_huge_histories(spark):
    from pyspark.sql.types import LongType

    n = F.lit(50_000_000_000).cast(LongType())
    raw = F.lit(1e12)
    df = spark.range(1).select(
        F.least(F.lit(3.0), n / F.lit(5.0)).cast("int").alias("t"),
        F.least(F.lit(5.0), F.greatest(F.lit(1.0), raw)).cast("int").alias("h"),
        F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.lit(-3.7))).cast("int").alias("h2"),
    )
    r = df.first()
    assert (r.t, r.h, r.h2) == (3, 5, 1)


def test_all_null_group_sums_to_zero_and_means_stay_missing(spark):
    st = statement(spark, [(1, "a", "1", d(100), None, None, None), (1, "a", "2", d(100), None, None, None)])
    r = CU.customer_rollup(st).first()
    assert r.balance == 0.0 and r.avg_days is None
    p = CU.customer_profiles(st, spark.createDataFrame([], PAY_SCHEMA)).first()
    assert p.total_balance == 0.0 and p.overdue_pct == 0.0 and p.recommended_limit is None


def test_pareto_with_negative_balances_and_ties(spark):
    from dunning.plans.concentration import pareto

    rows = [("b", 50.0), ("a", 50.0), ("c", -20.0), ("d", 120.0), ("a", 10.0)]
    st = statement(spark, [(i, n, str(i), d(100), d(10), 1.0, b) for i, (n, b) in enumerate(rows)])
    got = {r.customer_name: r for r in pareto(st, 80.0).collect()}
    per = {}
    for n, b in rows:
        per[n] = per.get(n, 0.0) + b
    ordered = sorted(per.items(), key=lambda kv: (-kv[1], kv[0]))
    total = sum(per.values())
    acc = 0.0
    for pos, (n, b) in enumerate(ordered, start=1):
        acc += b
        r = got[n]
        assert r.position == pos and r.cum_balance == pytest.approx(acc)
        assert r.cum_pct == pytest.approx(acc / total * 100)
        assert r.is_top_share == (acc / total * 100 <= 80.0)


def test_homonyms_merge_by_name_but_not_by_code(spark):
    from dunning.plans.concentration import pareto

    st = statement(spark, [(1, "same", "1", d(100), d(70), 1.0, 30.0), (2, "same", "2", d(100), d(70), 1.0, 12.0)])
    top = PO.top_customers(st).collect()
    assert [(r.customer_name, r.balance) for r in top] == [("same", 42.0)]
    assert pareto(st).count() == 1
    assert CU.customer_rollup(st).count() == 2


def test_credit_limit_missing_without_payments_unless_filled(spark):
    from dunning.plans import limits as LI

    st = statement(
        spark,
        [
            (1, "a", "1", d(100), d(10), 5000.0, 5000.0),
            (2, "b", "2", d(100), d(10), 8000.0, 8000.0),
            (3, "c", "3", d(100), d(10), 9000.0, 9000.0),
        ],
    )
    # two paying customers: with one, the spread of average payments (a
    # sample std) is undefined and every limit is missing, as in the reference
    pay = fill_payments(
        spark.createDataFrame(
            [
                (1, "a", "9", 1, d(5), 400.0, 400.0, 0.0, 0.0, 0.0),
                (1, "a", "8", 1, d(40), 600.0, 0.0, 600.0, 0.0, 0.0),
                (3, "c", "7", 1, d(20), 900.0, 900.0, 0.0, 0.0, 0.0),
            ],
            PAY_SCHEMA,
        )
    )
    plain = {r.customer_code: r for r in LI.credit_limits(st, pay, AS_OF).collect()}
    assert plain[2].credit_limit is None and plain[2].payment_count is None
    assert plain[1].credit_limit >= 1000.0
    assert "History of 2 payments with average $500.00" in plain[1].explanation
    assert "No payment history" in plain[2].explanation and "New customer" in plain[2].explanation
    filled = {r.customer_code: r for r in LI.credit_limits(st, pay, AS_OF, fill_missing=True).collect()}
    assert filled[2].credit_limit is not None and filled[2].credit_limit >= 1000.0
