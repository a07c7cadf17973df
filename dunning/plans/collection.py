"""Weekly collection goals and compliance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunning.functions import dates as D
from dunning.functions import labels as L
from dunning.functions.money import money_mean, money_sum, money_total, prob_mean
from dunning.operators.running import rows_to_goal, running_total, select_to_goal
from dunning.session import materialize, materialize_by

KEY = "customer_code"


def week_label(week_start: dt.date) -> str:
    end = week_start + dt.timedelta(days=6)
    return f"Week {week_start.isocalendar()[1]} ({week_start:%d/%m/%Y} - {end:%d/%m/%Y})"


def week_calendar(anchor: DataFrame, as_of_col: str = "as_of") -> DataFrame:
    """Mondays in [as_of - 3 weeks, as_of + 6 weeks] for every anchor row,
    with end (+6 d), year, ISO week, label and whether the week is future."""
    as_of = F.col(as_of_col)
    start = F.date_sub(as_of, 21)
    first_monday = F.date_add(start, (F.lit(7) - F.weekday(start)) % 7)
    end = F.date_add(as_of, 42)
    weeks = anchor.select(as_of, F.explode(F.sequence(first_monday, end, F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
    ws = F.col("week_start")
    we = F.date_add(ws, 6)
    return weeks.select(
        ws,
        we.alias("week_end"),
        F.year(ws).alias("year"),
        F.weekofyear(ws).alias("iso_week"),
        F.concat(
            F.lit("Week "), F.weekofyear(ws).cast("string"), F.lit(" ("), D.dmy(ws), F.lit(" - "), D.dmy(we), F.lit(")")
        ).alias("label"),
        (ws > as_of).alias("is_future"),
    )


def plan_scope(st: DataFrame, week_start: dt.date, include_overdue: bool = True) -> DataFrame:
    """Invoices in scope of a week's plan, by *invoice* date: up to the week's
    end when overdue invoices are included, else inside the week."""
    week_end = week_start + dt.timedelta(days=6)
    d = F.col("invoice_date")
    cond = d <= F.lit(week_end) if include_overdue else d.between(F.lit(week_start), F.lit(week_end))
    return st.where(cond)


def normalized_history(pay_filled: DataFrame) -> DataFrame:
    """Mean payment per customer over the largest such mean (1 when that is 0)."""
    # one row per customer, written once: the max below and the join that
    # uses this frame both read the checkpoint instead of re-aggregating
    per = materialize_by(
        pay_filled.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(money_mean(F.col("paid_amount")).alias("avg_paid")), KEY
    )
    top = per.select(F.max("avg_paid")).scalar()
    denom = F.when(top == 0, F.lit(1.0)).otherwise(top)
    return per.withColumn("history_norm", F.col("avg_paid") / denom)


def collection_score(scope: DataFrame, pay_filled: DataFrame) -> DataFrame:
    """Score = .5 (1 - mean p) + .3 history_norm + .2 balance / max balance,
    per (code, name); customers without payment history get .5."""
    plan = materialize_by(
        scope.where(F.col(KEY).isNotNull() & F.col("customer_name").isNotNull())
        .groupBy(KEY, "customer_name")
        .agg(
            money_sum(F.col("balance")).alias("_bal"),
            prob_mean(F.col("default_probability")).alias("avg_probability"),
        )
        .withColumn("balance", F.coalesce(F.col("_bal").cast("double"), F.lit(0.0))),
        KEY,
    )
    top = plan.select(F.max("balance")).scalar()
    denom = F.when(top == 0, F.lit(1.0)).otherwise(top)
    hist = normalized_history(pay_filled).select(KEY, "history_norm")
    scored = (
        plan.withColumn("balance_norm", F.col("balance") / denom)
        .join(hist, KEY, "left")
        .withColumn("history_norm", F.coalesce("history_norm", F.lit(0.5)))
    )
    score = (
        F.lit(0.5) * (F.lit(1.0) - F.col("avg_probability"))
        + F.lit(0.3) * F.col("history_norm")
        + F.lit(0.2) * F.col("balance_norm")
    )
    return scored.withColumn("collection_score", score)


PLAN_COLUMNS = [
    KEY,
    "customer_name",
    "balance",
    "avg_probability",
    "balance_norm",
    "history_norm",
    "collection_score",
    "position",
    "cum_balance",
]


def collection_plan(
    st: DataFrame, pay_filled: DataFrame, week_start: dt.date, goal: float, include_overdue: bool = True
) -> DataFrame:
    """Customers in score order with the running balance, cut greedily at the
    goal (the customer that reaches it is included)."""
    scored = collection_score(plan_scope(st, week_start, include_overdue), pay_filled)
    ranked = running_total(
        scored,
        [F.desc_nulls_last("collection_score"), F.asc(KEY), F.asc("customer_name")],
        (F.col("_bal") * 100).cast("long"),
        "_cum",
        position="position",
    ).withColumn("cum_balance", F.col("_cum").cast("double") / F.lit(100.0))
    return select_to_goal(ranked, goal, "cum_balance", "position").select(*PLAN_COLUMNS)


def collection_goal(st: DataFrame, pay_filled: DataFrame, week_start: dt.date, goal: float, include_overdue: bool = True) -> DataFrame:
    """The customers of :func:`collection_plan` without their running totals,
    found without ordering all customers."""
    scored = collection_score(plan_scope(st, week_start, include_overdue), pay_filled)
    scored = materialize(scored.withColumn("_cents", (F.col("_bal") * 100).cast("long")))
    chosen = rows_to_goal(scored, "collection_score", [KEY, "customer_name"], "_cents", goal)
    return chosen.select(KEY, "customer_name", "balance", "collection_score")


def week_payments(pay_filled: DataFrame, week_start: dt.date) -> DataFrame:
    week_end = week_start + dt.timedelta(days=6)
    return (
        pay_filled.where(F.col("payment_date").between(F.lit(week_start), F.lit(week_end)))
        .where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(money_total(F.col("paid_amount")).alias("week_paid"))
    )


def is_future(week_start: dt.date, as_of: dt.date) -> bool:
    return week_start > as_of


def plan_compliance(plan: DataFrame, pay_filled: DataFrame, week_start: dt.date, as_of: dt.date) -> DataFrame:
    """Paid in the week per planned customer and the compliance state."""
    if is_future(week_start, as_of):
        return plan.withColumn("paid_in_week", F.lit(0.0)).withColumn("compliance", F.lit(L.PLAN_FUTURE))
    paid = week_payments(pay_filled, week_start)
    return (
        plan.join(paid, KEY, "left")
        .withColumn("paid_in_week", F.coalesce("week_paid", F.lit(0.0)))
        .drop("week_paid")
        .withColumn(
            "compliance", F.when(F.col("paid_in_week") > 0, F.lit(L.PLAN_PAID)).otherwise(F.lit(L.PLAN_NOT_FULFILLED))
        )
    )


def weekly_kpis(plan: DataFrame, pay_filled: DataFrame, week_start: dt.date, goal: float, as_of: dt.date) -> DataFrame:
    """Goal, planned balance, everything collected in the week (planned or
    not) and the ratio; a future week has collected = ratio = 0."""
    week_end = week_start + dt.timedelta(days=6)
    if is_future(week_start, as_of):
        collected: Column = F.lit(0.0)
    else:
        collected = (
            pay_filled.where(F.col("payment_date").between(F.lit(week_start), F.lit(week_end)))
            .where(F.col(KEY).isNotNull())
            .select(money_total(F.col("paid_amount")))
            .scalar()
        )
    ratio = F.lit(0.0) if is_future(week_start, as_of) or goal <= 0 else collected / F.lit(goal)
    return plan.agg(money_total(F.col("balance")).alias("planned_balance")).select(
        F.lit(goal).alias("weekly_goal"),
        "planned_balance",
        collected.alias("collected"),
        ratio.alias("compliance_ratio"),
    )


def monthly_kpis(pay_filled: DataFrame, week_start: dt.date, goal: float) -> DataFrame:
    """Collected in the calendar month of the week's start against 4 x goal."""
    d = F.col("payment_date")
    monthly_goal = goal * 4
    first = week_start.replace(day=1)
    last = (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    one = pay_filled.where(d.between(F.lit(first), F.lit(last))).agg(
        money_total(F.col("paid_amount")).alias("collected")
    )
    ratio = F.col("collected") / F.lit(monthly_goal) if monthly_goal > 0 else F.lit(0.0)
    return one.select(F.lit(monthly_goal).alias("monthly_goal"), "collected", ratio.alias("compliance_ratio"))


def payments_outside_plan(plan: DataFrame, pay_filled: DataFrame, st: DataFrame, week_start: dt.date, as_of: dt.date) -> DataFrame:
    """Customers who paid in the week without being planned (anti-join), with
    one row per distinct (name, invoice probability) of theirs."""
    paid = week_payments(pay_filled, week_start).join(plan.select(KEY), KEY, "left_anti")
    if is_future(week_start, as_of):
        paid = paid.where(F.lit(False))
    # only the statement rows of these customers are made distinct and shuffled
    facts = st.select(KEY, "customer_name", "default_probability").join(paid.select(KEY), KEY, "left_semi").distinct()
    return paid.join(facts, KEY, "left").select(KEY, F.col("week_paid").alias("paid"), "customer_name", "default_probability")
