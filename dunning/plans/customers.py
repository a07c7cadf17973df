"""Customer-level views for all customers at once (U1, G1-G3, W4, W5, A13,
A14, Z1, Z2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunning.functions import classify as C
from dunning.functions import dates as D
from dunning.functions import labels as L
from dunning.functions.money import money_mean, money_total, prob_mean
from dunning.operators.modal import any_name, label_counts, modal_by_rank, modal_label

KEY = "customer_code"
SEVERE_DAYS = 60


def _keyed(df: DataFrame) -> DataFrame:
    """pandas drops NULL group keys; so do we, before every groupBy."""
    return df.where(F.col(KEY).isNotNull())


def all_customers(st: DataFrame, pay: DataFrame) -> DataFrame:
    """One row per code from both tables; the statement's name wins."""
    a = _keyed(st).groupBy(KEY).agg(any_name(F.col("customer_name"), st).alias("_sn"), F.lit(True).alias("in_statement"))
    b = _keyed(pay).groupBy(KEY).agg(any_name(F.col("customer_name"), pay).alias("_pn"), F.lit(True).alias("in_payments"))
    j = a.join(b, KEY, "full")
    name = F.when(F.col("in_statement"), F.col("_sn")).otherwise(F.col("_pn"))
    return j.select(
        KEY,
        name.alias("customer_name"),
        F.concat_ws(" - ", F.col(KEY).cast("string"), name).alias("label"),
        F.coalesce("in_statement", F.lit(False)).alias("in_statement"),
        F.coalesce("in_payments", F.lit(False)).alias("in_payments"),
    )


def customer_profiles(st: DataFrame, pay: DataFrame) -> DataFrame:
    """G1/G2 for every customer of either table; invoice metrics are NULL for
    customers without invoices."""
    bal = F.col("balance")
    agg = _keyed(st).groupBy(KEY).agg(
        any_name(F.col("customer_name"), st).alias("_sn"),
        F.count(F.lit(1)).alias("invoice_count"),
        money_total(bal).alias("total_balance"),
        F.avg("days_past_due").alias("avg_days"),
        money_total(F.when(F.col("days_past_due") > SEVERE_DAYS, bal)).alias("_late"),
        prob_mean(F.col("default_probability")).alias("avg_probability"),
        money_mean(F.col("initial_amount")).alias("_avg_initial"),
        F.lit(True).alias("_in_st"),
    )
    names = _keyed(pay).groupBy(KEY).agg(any_name(F.col("customer_name"), pay).alias("_pn"))
    j = agg.join(names, KEY, "full")
    has = F.coalesce(F.col("_in_st"), F.lit(False))
    pct = F.when(F.col("total_balance") > 0, F.col("_late") / F.col("total_balance") * F.lit(100.0)).otherwise(F.lit(0.0))
    return j.select(
        KEY,
        F.when(has, F.col("_sn")).otherwise(F.col("_pn")).alias("customer_name"),
        has.alias("has_invoices"),
        "invoice_count",
        "total_balance",
        "avg_days",
        F.when(has, pct).alias("overdue_pct"),
        "avg_probability",
        (F.col("_avg_initial") * F.lit(0.8)).alias("recommended_limit"),
    )


def payments_only_customers(st: DataFrame, pay_filled: DataFrame) -> DataFrame:
    """Customers that only appear in payments.  Payments are aggregated
    per customer first (map-side combine absorbs a hot customer), then the
    per-customer rows are anti-joined with the distinct statement codes."""
    paid = F.col("paid_amount")
    per = _keyed(pay_filled).groupBy(KEY).agg(
        any_name(F.col("customer_name"), pay_filled).alias("customer_name"),
        F.count(F.lit(1)).alias("payment_count"),
        money_mean(paid).alias("avg_paid"),
        F.max("payment_date").alias("last_payment"),
        money_total(paid).alias("total_paid"),
    )
    only = per.join(_keyed(st).select(KEY).distinct(), KEY, "left_anti")
    return only.withColumn("last_payment_text", F.coalesce(D.dmy(F.col("last_payment")), F.lit("N/A")))


def payment_order() -> list:
    """Latest first; the rest only makes the order total."""
    return [
        F.desc_nulls_last("payment_date"),
        F.asc_nulls_last("document_no"),
        F.asc_nulls_last("line_no"),
        F.desc_nulls_last("paid_amount"),
        F.desc_nulls_last("cash"),
        F.desc_nulls_last("cheque"),
        F.desc_nulls_last("card"),
        F.desc_nulls_last("transfer"),
    ]


def last_payments(pay_filled: DataFrame, n: int = 5) -> DataFrame:
    """Latest ``n`` payments per customer.  ``row_number() <= n`` is planned
    as a partial WindowGroupLimit before the shuffle, so a customer with a
    huge history ships at most ``n`` rows per map task."""
    w = Window.partitionBy(KEY).orderBy(*payment_order())
    return (
        _keyed(pay_filled)
        .withColumn("payment_rank", F.row_number().over(w))
        .where(F.col("payment_rank") <= n)
        .select(KEY, "payment_rank", "payment_date", "document_no", "line_no", "paid_amount", "cash", "cheque", "card", "transfer")
    )


def payment_timeline(pay_filled: DataFrame) -> DataFrame:
    """Every payment in (customer, date) order.  A global sort is range
    partitioned on the whole key, so one busy customer spreads over tasks."""
    return (
        _keyed(pay_filled)
        .select(KEY, "payment_date", "document_no", "line_no", "paid_amount")
        .orderBy(KEY, F.asc_nulls_last("payment_date"), "document_no", "line_no", "paid_amount")
    )


def customer_modal_status(st: DataFrame) -> DataFrame:
    s = F.col("aging_status")
    return modal_by_rank(_keyed(st), [KEY], s, C.status_rank(s), "modal_status")


def customer_rollup(st: DataFrame) -> DataFrame:
    """First name, mean days, balance, mean probability, modal status --
    one aggregation, the mode taken over the five known status labels."""
    s = F.col("aging_status")
    agg = _keyed(st).groupBy(KEY).agg(
        any_name(F.col("customer_name"), st).alias("customer_name"),
        F.avg("days_past_due").alias("avg_days"),
        money_total(F.col("balance")).alias("balance"),
        prob_mean(F.col("default_probability")).alias("avg_probability"),
        *label_counts(s, L.STATUSES, "_st"),
    )
    return agg.select(
        KEY,
        "customer_name",
        "avg_days",
        "balance",
        "avg_probability",
        F.coalesce(modal_label(L.STATUSES, "_st"), F.lit(L.NO_DATA)).alias("modal_status"),
    )


def payment_history(pay_filled: DataFrame, as_of: dt.date) -> DataFrame:
    """Totals, mean, count, first/last date and days since the last
    payment (the reference calls it seniority)."""
    paid = F.col("paid_amount")
    return (
        _keyed(pay_filled)
        .groupBy(KEY)
        .agg(
            money_total(paid).alias("total_paid"),
            money_mean(paid).alias("avg_paid"),
            F.count(paid).alias("payment_count"),
            F.min("payment_date").alias("first_payment"),
            F.max("payment_date").alias("last_payment"),
        )
        .withColumn("days_since_last_payment", F.datediff(F.lit(as_of), F.col("last_payment")))
    )
