"""Payment-method analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunning.functions import labels as L
from dunning.functions.money import money_mean, money_sum, money_total

METHODS = L.PAYMENT_METHODS


def _stack(pairs: list[tuple[str, ...]], names: str) -> str:
    body = ", ".join(", ".join(p) for p in pairs)
    return f"stack({len(pairs)}, {body}) AS ({names})"


def payment_method_totals(pay_filled: DataFrame, by: str | None = None) -> DataFrame:
    """Amount per method (all customers, or per ``by`` key): sums first, then
    one row per method."""
    src = pay_filled if by is None else pay_filled.where(F.col(by).isNotNull())
    aggs = [money_total(F.col(c)).alias(c) for c, _ in METHODS]
    sums = src.agg(*aggs) if by is None else src.groupBy(by).agg(*aggs)
    keys = [] if by is None else [by]
    return sums.selectExpr(*keys, _stack([(f"'{label}'", f"`{c}`") for c, label in METHODS], "method, amount"))


def payment_method_summary(pay_filled: DataFrame) -> DataFrame:
    """Per method with a positive amount: total of the whole payment (mixed
    payments count under each of their methods), transactions and share of
    the four totals.  One aggregation pass; sorted by total, numerically."""
    paid = F.col("paid_amount")
    aggs = []
    for c, _ in METHODS:
        hit = F.col(c) > 0
        aggs += [money_sum(F.when(hit, paid)).alias(f"t_{c}"), F.count(F.when(hit, 1)).alias(f"n_{c}")]
    one = pay_filled.agg(*aggs)
    grand = sum((F.coalesce(F.col(f"t_{c}"), F.lit(0)) for c, _ in METHODS[1:]), F.coalesce(F.col(f"t_{METHODS[0][0]}"), F.lit(0)))
    one = one.withColumn("_grand", grand.cast("double"))
    for c, _ in METHODS:
        total = F.coalesce(F.col(f"t_{c}").cast("double"), F.lit(0.0))
        one = one.withColumn(f"d_{c}", total).withColumn(f"s_{c}", F.try_divide(total, F.col("_grand")))
    rows = one.selectExpr(
        _stack([(f"'{label}'", f"d_{c}", f"n_{c}", f"s_{c}") for c, label in METHODS], "method, total_paid, transactions, share")
    )
    return rows.orderBy(F.desc("total_paid"), "method")


def payment_stats(pay: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """On the *unfilled* view: total, mean (NULLs skipped), rows, customers."""
    paid = F.col("paid_amount")
    return pay.agg(
        money_total(paid).alias("total_paid"),
        money_mean(paid).alias("avg_paid"),
        F.count(F.lit(1)).alias("transactions"),
        (F.approx_count_distinct("customer_code", 0.01) if approx_distinct else F.count_distinct("customer_code")).alias(
            "customers"
        ),
    )


def payments_with_status(pay_filled: DataFrame, st: DataFrame) -> DataFrame:
    """Per (customer, method) payment totals joined to every distinct
    status of that customer -- a deliberate fan-out that defines the
    reference's totals.  Payments are pre-aggregated per (customer, method)
    before the join, so a customer with a huge number of payments costs at
    most four rows on the join."""
    stacked = pay_filled.selectExpr(
        "customer_code",
        "paid_amount",
        _stack([(f"'{label}'", f"`{c}`") for c, label in METHODS], "method, method_amount"),
    ).where(F.col("method_amount") > 0)
    pre = stacked.groupBy("customer_code", "method").agg(
        money_sum(F.col("paid_amount")).alias("paid_dec"), F.count(F.lit(1)).alias("n")
    )
    statuses = st.select(F.col("customer_code").alias("_sc"), "aging_status").distinct()
    return pre.join(statuses, pre["customer_code"].eqNullSafe(statuses["_sc"]), "left").select(
        "customer_code",
        "method",
        "paid_dec",
        "n",
        F.coalesce("aging_status", F.lit(L.NO_DATA)).alias("aging_status"),
    )


def payment_method_by_status(pay_filled: DataFrame, st: DataFrame) -> DataFrame:
    """Method x status totals, distinct customers, transactions and share
    of the (fanned-out) grand total."""
    g = (
        payments_with_status(pay_filled, st)
        .groupBy("method", "aging_status")
        .agg(
            F.sum("paid_dec").alias("_t"),
            F.count("customer_code").alias("customers"),
            F.sum("n").alias("transactions"),
        )
    )
    # g has at most 4 methods x 6 statuses rows: a window over all of it is bounded
    grand = F.sum("_t").over(Window.partitionBy()).cast("double")
    total = F.col("_t").cast("double")
    return g.select(
        "method",
        "aging_status",
        total.alias("total_paid"),
        "transactions",
        "customers",
        F.try_divide(total, grand).alias("share"),
    ).orderBy("method", F.desc("total_paid"))
