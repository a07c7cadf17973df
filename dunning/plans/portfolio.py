"""Executive summary and aging analysis over the classified statement
(A1-A3, A8-A12, A19, T1/T2, P5-P7, J7, F1/F2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.functions import dates as D
from dunning.functions import dims
from dunning.functions import labels as L
from dunning.functions import text as T
from dunning.functions.money import as_double, money, money_sum, money_total, prob_mean
from dunning.operators.distribution import box_summary
from dunning.operators.heavy import CAPACITY, top_sums
from dunning.operators.keys import join_on
from dunning.operators.quantile_sketch import measured_ranks, merge_sketches, rank_error, sketch_values, sketched_box
from dunning.operators.selection import cents, exact_box
from dunning.session import materialize

OVERDUE_DAYS = 30  # KPI threshold (A1)
SEVERE_DAYS = 60  # top debtors, customer %, model label


def distinct_count(c, approx: bool = False):
    """Exact distinct count, or HyperLogLog++ (``approx_count_distinct``,
    about 1% error, fixed memory) when ``approx`` -- the opt-in for tables
    where the exact count's extra aggregation level is not wanted."""
    return F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(c)


def portfolio_kpis(st: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row, one pass: total, overdue (>30 d) balance and customers,
    ratio and DSO (0 when the total is not positive)."""
    late = F.col("days_past_due") > OVERDUE_DAYS
    agg = st.agg(
        money_total(F.col("balance")).alias("total_balance"),
        money_total(F.when(late, F.col("balance"))).alias("overdue_balance"),
        distinct_count(F.when(late, F.col("customer_code")), approx_distinct).alias("overdue_customers"),
        F.coalesce(F.sum(money(F.col("balance")) * F.col("days_past_due")).cast("double"), F.lit(0.0)).alias("_wdays"),
    )
    positive = F.col("total_balance") > 0
    return agg.select(
        "total_balance",
        "overdue_balance",
        "overdue_customers",
        F.when(positive, F.col("overdue_balance") / F.col("total_balance")).otherwise(F.lit(0.0)).alias("overdue_ratio"),
        F.when(positive, F.col("_wdays") / F.col("total_balance")).otherwise(F.lit(0.0)).alias("dso_days"),
    )


def monthly_balance(st: DataFrame) -> DataFrame:
    return st.groupBy(D.month_period(F.col("invoice_date")).alias("invoice_month")).agg(
        money_total(F.col("balance")).alias("balance")
    )


def balance_by_status(st: DataFrame) -> DataFrame:
    return (
        st.where(F.col("aging_status").isNotNull())
        .groupBy("aging_status")
        .agg(money_total(F.col("balance")).alias("balance"))
    )


def aging_totals(st: DataFrame) -> DataFrame:
    """Sum the five bucket columns in one pass, then turn the single row into
    five (range, amount) rows."""
    sums = st.agg(*[money_total(F.col(c)).alias(c) for c, _ in L.AGING_BUCKETS])
    pairs = ", ".join(f"'{label}', `{c}`" for c, label in L.AGING_BUCKETS)
    return sums.selectExpr(f"stack({len(L.AGING_BUCKETS)}, {pairs}) AS (aging_range, amount)")


def balance_by_due_weekday(st: DataFrame) -> DataFrame:
    d = F.col("due_date")
    return (
        st.where(d.isNotNull())
        .groupBy(D.weekday_index(d).alias("weekday_index"), D.weekday_name(d).alias("due_weekday"))
        .agg(money_total(F.col("balance")).alias("balance"))
        .orderBy("weekday_index")
    )


def balance_by_due_month(st: DataFrame) -> DataFrame:
    d = F.col("due_date")
    return (
        st.where(d.isNotNull())
        .groupBy(F.month(d).alias("month_index"), D.month_name(d).alias("due_month"))
        .agg(money_total(F.col("balance")).alias("balance"))
        .orderBy("month_index")
    )


STATUS_COLUMNS = (
    ("current", L.STATUS_CURRENT),
    ("early_warning", L.STATUS_EARLY),
    ("moderate", L.STATUS_MODERATE),
    ("high", L.STATUS_HIGH),
    ("severe", L.STATUS_SEVERE),
)


def monthly_status_matrix(st: DataFrame) -> DataFrame:
    """Month x status pivot with missing cells 0.  The five labels are known,
    so this is one aggregation with conditional sums (no distinct-values job,
    no second pivot aggregation)."""
    s = F.col("aging_status")
    return st.groupBy(D.month_period(F.col("invoice_date")).alias("invoice_month")).agg(
        *[money_total(F.when(s == label, F.col("balance"))).alias(name) for name, label in STATUS_COLUMNS]
    )


def breakdowns(st: DataFrame) -> DataFrame:
    """The sums behind five reports (A2, A3, A9, A10, A11) and the bucket
    totals (A8) from one scan: grouping sets by invoice month, status, due
    weekday and due month, and over all.  One row for each group; ``part``
    names the set."""
    invoice, due = F.col("invoice_date"), F.col("due_date")
    keys = {
        "invoice_month": D.month_period(invoice),
        "aging_status": F.col("aging_status"),
        "weekday_index": D.weekday_index(due),
        "due_weekday": D.weekday_name(due),
        "month_index": F.month(due),
        "due_month": D.month_name(due),
    }
    sets = {"month": ["invoice_month"], "status": ["aging_status"], "weekday": ["weekday_index", "due_weekday"], "due": ["month_index", "due_month"], "all": []}
    amount = F.col("_balance")
    status = F.col("_status")
    rows = st.select(*[v.alias(c) for c, v in keys.items()], F.col("balance").alias("_balance"), F.col("aging_status").alias("_status"), *[c for c, _ in L.AGING_BUCKETS])
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in keys])
    # the grouping id has a bit for each key that is not in the row's set
    ids = {name: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in s) for name, s in sets.items()}
    part = F.coalesce(*[F.when(F.grouping_id() == n, F.lit(name)) for name, n in ids.items()])
    return grouped.agg(
        part.alias("part"),
        money_total(amount).alias("balance"),
        *[money_total(F.when(status == label, amount)).alias(name) for name, label in STATUS_COLUMNS],
        *[money_total(F.col(c)).alias(c) for c, _ in L.AGING_BUCKETS],
    )


def reports_of(parts: DataFrame) -> dict[str, DataFrame]:
    """The six reports from :func:`breakdowns`, which is best written first."""
    of = lambda name: parts.where(F.col("part") == name)
    pairs = ", ".join(f"'{label}', `{c}`" for c, label in L.AGING_BUCKETS)
    return {
        "monthly_balance": of("month").select("invoice_month", "balance"),
        "balance_by_status": of("status").where(F.col("aging_status").isNotNull()).select("aging_status", "balance"),
        "aging_totals": of("all").selectExpr(f"stack({len(L.AGING_BUCKETS)}, {pairs}) AS (aging_range, amount)"),
        "balance_by_due_weekday": of("weekday").where("weekday_index IS NOT NULL").select("weekday_index", "due_weekday", "balance").orderBy("weekday_index"),
        "balance_by_due_month": of("due").where("month_index IS NOT NULL").select("month_index", "due_month", "balance").orderBy("month_index"),
        "monthly_status_matrix": of("month").select("invoice_month", *[c for c, _ in STATUS_COLUMNS]),
    }


def risk_profiles(st: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per segment: mean days, balance, distinct customers, mean probability.
    All four segments are emitted (pandas categorical behaviour)."""
    spark = st.sparkSession
    prof = (
        st.where(F.col("risk_segment").isNotNull())
        .groupBy("risk_segment")
        .agg(
            F.avg("days_past_due").alias("avg_days"),
            money_sum(F.col("balance")).alias("_bal"),
            distinct_count(F.col("customer_code"), approx_distinct).alias("customers"),
            prob_mean(F.col("default_probability")).alias("avg_probability"),
        )
    )
    # the 4-row dimension drives the left join; the (at most 4-row) profile
    # side is broadcast by AQE once its real size is known
    seg = dims.segment_dim(spark).select("segment_rank", "risk_segment")
    return seg.join(prof, "risk_segment", "left").select(
        "segment_rank",
        "risk_segment",
        "avg_days",
        F.coalesce(as_double(F.col("_bal")), F.lit(0.0)).alias("balance"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
        "avg_probability",
    )


def top_customers(st: DataFrame, n: int = 10, min_days: int | None = None) -> DataFrame:
    """Top ``n`` customer *names* by balance (homonyms merge), with mean days.
    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each task keeps
    its own top n, so nothing big reaches one task."""
    df = st if min_days is None else st.where(F.col("days_past_due") > min_days)
    return (
        df.where(F.col("customer_name").isNotNull())
        .groupBy("customer_name")
        .agg(money_total(F.col("balance")).alias("balance"), F.avg("days_past_due").alias("avg_days"))
        .orderBy(F.desc("balance"), F.asc("customer_name"))
        .limit(n)
    )


def top_customers_certified(st: DataFrame, n: int = 10, min_days: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """:func:`top_customers` where names are too many to be shuffled: the sums
    of a few candidates, with a certificate that no other name can enter."""
    df = st if min_days is None else st.where(F.col("days_past_due") > min_days)
    df = df.withColumn("_cents", cents(F.col("balance")))
    return top_sums(df, "customer_name", "_cents", n, lambda rows: top_customers(rows, n), "balance", capacity)


def days_box(st: DataFrame, by: str | None = None) -> DataFrame:
    return box_summary(st, "days_past_due", [by] if by else None)


def balance_box(st: DataFrame, by: str | None = None) -> DataFrame:
    """Box statistics of the balances, exact, with any number of amounts."""
    return exact_box(st, "balance", [by] if by else None, image="money")


def monthly_sketches(st: DataFrame, value: str = "balance", by: tuple[str, ...] = ("aging_status",)) -> DataFrame:
    """One quantile sketch for each group and invoice month, to be stored."""
    return sketch_values(st.withColumn("invoice_month", D.month_period(F.col("invoice_date"))), value, [*by, "invoice_month"])


def balance_box_sketch(st: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Box statistics of the balances by status from monthly sketches, for the
    months from ``first`` to ``last`` (None: all)."""
    stored = materialize(monthly_sketches(st))
    month = F.to_date(F.concat("invoice_month", F.lit("-01")))
    if first is not None:
        stored = stored.where(month >= F.lit(first.replace(day=1)))
    if last is not None:
        stored = stored.where(month <= F.lit(last))
    return sketched_box(merge_sketches(stored, ["aging_status"]), ["aging_status"])


def checked_sketches(rows: DataFrame, value: str, by: list[str], boxes: DataFrame) -> DataFrame:
    """What of sketched boxes is certain, and whether each quartile's rank,
    measured against all rows, keeps its bound (three times the 99 % bound)."""
    boxes = materialize(boxes)
    met = join_on(boxes, measured_ranks(rows, value, by, boxes), by)
    bound = F.lit(3 * rank_error())
    return met.select(
        *by, "n", "min_value", "max_value", *[(F.col(f"{c}_error") <= bound).alias(f"{c}_within") for c in ("q1", "median", "q3")]
    )


def filter_statement(st: DataFrame, start: dt.date | None = None, end: dt.date | None = None, statuses=None) -> DataFrame:
    """Report filter: invoice date in [start, end] and status in the set; what
    is None filters nothing."""
    if start is not None:
        st = st.where(F.col("invoice_date") >= F.lit(start))
    if end is not None:
        st = st.where(F.col("invoice_date") <= F.lit(end))
    return st if statuses is None else st.where(F.col("aging_status").isin(list(statuses)))


def filter_domain(st: DataFrame) -> DataFrame:
    """Bounds for the report filter widgets: date range and status list
    (at most five labels, so the collected set is bounded)."""
    return st.agg(
        F.min("invoice_date").alias("min_invoice_date"),
        F.max("invoice_date").alias("max_invoice_date"),
        F.array_join(F.array_sort(F.collect_set("aging_status")), "|").alias("statuses"),
    )


def segment_action_plan(st: DataFrame) -> DataFrame:
    """Each invoice with its segment's action plan and follow-up frequency."""
    seg = dims.segment_dim(st.sparkSession)
    return st.join(seg, "risk_segment", "left").select(
        "document_no", "customer_code", "risk_segment", "segment_rank", "actions", "follow_up"
    )


def formatted_amounts(st: DataFrame) -> DataFrame:
    """Display texts: balance as currency, probability as percent."""
    return st.select(
        "document_no",
        "balance",
        T.fmt_currency(F.col("balance")).alias("balance_text"),
        T.fmt_currency(F.col("initial_amount")).alias("initial_text"),
        T.fmt_percent(F.col("default_probability")).alias("probability_text"),
    )


def formatted_percents(st: DataFrame) -> DataFrame:
    """Display texts of numbers, and of text cells that may hold none."""
    cell = F.when(F.col("days_past_due") > OVERDUE_DAYS, F.col("aging_status")).otherwise(F.col("default_probability").cast("string"))
    return st.select(
        "document_no",
        T.fmt_percent(F.col("default_probability")).alias("probability_text"),
        T.fmt_percent(cell, text=True).alias("cell_percent"),
        T.fmt_currency(cell, text=True).alias("cell_currency"),
    )
