"""Pareto concentration of balance by customer name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.functions.money import money_sum
from dunning.operators.running import running_total


def pareto(st: DataFrame, pct: float = 80.0) -> DataFrame:
    """Balance per name, ordered by balance desc (ties: name), with the
    cumulative share of the total in percent and the ``<= pct`` flag (the
    customer that crosses the line is not flagged)."""
    per = (
        st.where(F.col("customer_name").isNotNull())
        .groupBy("customer_name")
        .agg(money_sum(F.col("balance")).alias("_bal"))
        .select(
            "customer_name",
            F.coalesce(F.col("_bal").cast("double"), F.lit(0.0)).alias("balance"),
            F.coalesce((F.col("_bal") * 100).cast("long"), F.lit(0)).alias("_cents"),
        )
    )
    ranked = running_total(per, [F.desc("balance"), F.asc("customer_name")], F.col("_cents"), "_cum", position="position")
    total = ranked.select(F.sum("_cents").cast("double") / F.lit(100.0)).scalar()
    cum = F.col("_cum").cast("double") / F.lit(100.0)
    share = F.try_divide(cum, total) * F.lit(100.0)
    return ranked.select(
        "position",
        "customer_name",
        "balance",
        cum.alias("cum_balance"),
        share.alias("cum_pct"),
        (share <= F.lit(float(pct))).alias("is_top_share"),
    )
