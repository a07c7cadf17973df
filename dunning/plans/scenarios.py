"""What-if credit risk for every customer under a grid of scenarios (C6, C7,
J8).  The reference simulates one customer picked in a form; here every
customer of either table is crossed with a small literal scenario grid via
``inline`` (a Generate, not a join), so the output is exactly
customers x scenarios rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dunning.functions import labels as L
from dunning.functions.dims import literal_frame
from dunning.functions.money import WIDE_INT, fixed_point, money_mean, money_total, prob_mean, sample_std
from dunning.operators.modal import any_name

KEY = "customer_code"
DEFAULT_AMOUNT = 10000.0
DEFAULT_RISK = 0.3
DEFAULT_HISTORY = 3
EPS = 1e-6


@dataclass(frozen=True)
class Scenario:
    scenario_id: int
    amount: float | None = None  # None: the customer's own base amount
    term_days: int = 30
    history: int | None = None  # None: derived from the customer's payments
    customer_type: str | None = None  # None: derived from the payment count


DEFAULT_GRID = (
    Scenario(1),
    Scenario(2, term_days=60),
    Scenario(3, amount=50_000.0),
    Scenario(4, history=5),
    Scenario(5, term_days=15, history=1, customer_type="New"),
    Scenario(6, amount=250_000.0, term_days=90, customer_type="Preferred"),
)


def _grid_column(grid) -> Column:
    rows = [
        F.struct(
            F.lit(s.scenario_id).cast("int").alias("scenario_id"),
            F.lit(s.amount).cast("double").alias("scenario_amount"),
            F.lit(s.term_days).cast("int").alias("term_days"),
            F.lit(s.history).cast("int").alias("history_override"),
            F.lit(s.customer_type).cast("string").alias("type_override"),
        )
        for s in grid
    ]
    return F.inline(F.array(*rows))


def _type_name(index: Column) -> Column:
    out = F.when(index == 0, F.lit(L.CUSTOMER_TYPES[0][0]))
    for i, (name, _) in enumerate(L.CUSTOMER_TYPES[1:], start=1):
        out = out.when(index == i, F.lit(name))
    return out


def _type_factor(name: Column) -> Column:
    out = F.when(name == L.CUSTOMER_TYPES[0][0], F.lit(L.CUSTOMER_TYPES[0][1]))
    for t, f in L.CUSTOMER_TYPES[1:]:
        out = out.when(name == t, F.lit(f))
    return out


def customer_risk_inputs(st: DataFrame, pay_filled: DataFrame) -> DataFrame:
    """Per customer: base amount, current risk, derived history score and
    customer type, and the payment-variability risk floor."""
    # each table is aggregated once per customer (name pick included), then
    # one full outer join gives every customer of either table (U1 semantics:
    # the statement's name wins)
    s = (
        st.where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(
            any_name(F.col("customer_name"), st).alias("_sn"),
            prob_mean(F.col("default_probability")).alias("_risk"),
            money_total(F.col("balance")).alias("_balance"),
            F.avg("days_past_due").alias("_days"),
            money_mean(F.col("initial_amount")).alias("_avg_initial"),
            F.lit(True).alias("in_statement"),
        )
    )
    paid = F.col("paid_amount")
    p = (
        pay_filled.where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(
            any_name(F.col("customer_name"), pay_filled).alias("_pn"),
            F.count(F.lit(1)).alias("payment_count"),
            money_mean(paid).alias("_avg_paid"),
            F.sum(fixed_point(paid, 2)).cast(WIDE_INT).alias("_s1"),
            F.sum(fixed_point(paid, 2) * fixed_point(paid, 2)).cast(WIDE_INT).alias("_s2"),
            F.datediff(F.max("payment_date"), F.min("payment_date")).alias("_span"),
            F.lit(True).alias("in_payments"),
        )
    )
    j = s.join(p, KEY, "full").withColumns(
        {
            "in_statement": F.coalesce("in_statement", F.lit(False)),
            "in_payments": F.coalesce("in_payments", F.lit(False)),
        }
    )
    j = j.withColumn("customer_name", F.when(F.col("in_statement"), F.col("_sn")).otherwise(F.col("_pn")))
    has_inv, has_pay = F.col("in_statement"), F.col("in_payments")
    n = F.col("payment_count")
    base = (
        F.when(has_inv & F.col("_avg_initial").isNotNull(), F.col("_avg_initial"))
        .when(has_pay, F.col("_avg_paid"))
        .otherwise(F.lit(DEFAULT_AMOUNT))
    )
    # one payment: the sample std is undefined; the reference would fail, we use 0
    std = F.coalesce(sample_std(n, F.col("_s1"), F.col("_s2"), 2), F.lit(0.0))
    freq = F.when(n > 1, F.col("_span") / n).otherwise(F.lit(30.0))
    j = j.withColumn("base_amount", base).withColumn("_std", F.when(has_pay, std)).withColumn("_freq", freq)
    b, sd, fq = F.col("base_amount"), F.col("_std"), F.col("_freq")
    raw_history = (
        n / F.lit(10.0)
        + F.when(b > 0, F.lit(1.0) - sd / b).otherwise(F.lit(0.0))
        + F.when(fq > 0, F.lit(30.0) / fq).otherwise(F.lit(1.0))
    )
    # clamp first, then truncate: same values as clamp(trunc(x)) for these
    # integer bounds, and the int cast can never overflow (a customer with
    # billions of payments would otherwise fail the job under ANSI mode)
    history = F.when(
        has_pay, F.least(F.lit(5.0), F.greatest(F.lit(1.0), raw_history)).cast("int")
    ).otherwise(F.lit(DEFAULT_HISTORY))
    type_index = F.when(has_pay, F.least(F.lit(3.0), n / F.lit(5.0)).cast("int")).otherwise(F.lit(0))
    current = F.when(has_inv, F.col("_risk")).otherwise(F.lit(DEFAULT_RISK))
    risk_base = F.when(has_pay, F.greatest(current, F.least(F.lit(0.7), sd / (b + F.lit(EPS))))).otherwise(current)
    return j.select(
        KEY,
        "customer_name",
        F.col("in_statement").alias("has_invoices"),
        F.col("in_payments").alias("has_payments"),
        "base_amount",
        F.when(has_inv, F.col("_balance")).otherwise(F.lit(0.0)).alias("current_balance"),
        F.when(has_inv, F.col("_days")).otherwise(F.lit(0.0)).alias("current_days"),
        current.alias("current_risk"),
        history.alias("history_score"),
        _type_name(type_index).alias("derived_type"),
        risk_base.alias("risk_base"),
    )


def score_scenarios(st: DataFrame, pay_filled: DataFrame, grid=DEFAULT_GRID) -> DataFrame:
    """Simulated risk = min(risk_base x amount factor x term factor x history
    factor x type factor, 0.99) for every customer and scenario."""
    inputs = customer_risk_inputs(st, pay_filled)
    x = inputs.select("*", _grid_column(grid))
    b = F.col("base_amount")
    amount = F.coalesce(F.col("scenario_amount"), b)
    history = F.coalesce(F.col("history_override"), F.col("history_score"))
    ctype = F.coalesce(F.col("type_override"), F.col("derived_type"))
    f_amount = F.least(amount / (b + F.lit(EPS)), F.lit(3.0))
    f_term = F.col("term_days") / F.lit(30)
    f_history = F.lit(1.5) - history * F.lit(0.1)
    risk = F.least(F.col("risk_base") * f_amount * f_term * f_history * _type_factor(ctype), F.lit(0.99))
    return x.select(
        KEY,
        "customer_name",
        "scenario_id",
        "has_invoices",
        "base_amount",
        "current_risk",
        "risk_base",
        amount.alias("amount"),
        "term_days",
        history.alias("history_score"),
        ctype.alias("customer_type"),
        risk.alias("simulated_risk"),
    )


def band_dim(spark: SparkSession) -> DataFrame:
    """4 rows: band code, label and its numbered recommendation list."""
    schema = StructType(
        [StructField("band", StringType(), False), StructField("band_label", StringType(), False), StructField("actions", StringType(), False)]
    )
    rows = [
        (band, label, "\n".join(f"{i}. {a}" for i, a in enumerate(actions, start=1)))
        for band, label, actions in L.SCENARIO_BANDS
    ]
    return F.broadcast(literal_frame(spark, rows, schema))


def scenario_band(scenarios: DataFrame) -> DataFrame:
    """Risk band of each simulated risk (>.8 and >.6 both read "High Risk"),
    its recommendations, and the extra warning for a critical customer
    without invoices."""
    r = F.col("simulated_risk")
    band = (
        F.when(r > 0.8, F.lit("critical")).when(r > 0.6, F.lit("high")).when(r > 0.4, F.lit("moderate")).otherwise(F.lit("low"))
    )
    banded = scenarios.withColumn("band", band)
    return banded.join(band_dim(scenarios.sparkSession), "band", "left").select(
        KEY,
        "scenario_id",
        "simulated_risk",
        "band",
        "band_label",
        ((F.col("band") == "critical") & ~F.col("has_invoices")).alias("needs_external_check"),
        "actions",
    )
