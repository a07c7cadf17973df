"""Recommended credit limits with explanations.

Factor formulas follow the reference exactly, including its quirks:
history uses one global spread of the per-customer average payment, more
days since the last payment *raise* the recency factor, and customers
without payments get a missing limit (``fill_missing`` turns missing factors
into the reference's neutral 0.5 instead).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunning.functions import classify as C
from dunning.functions import labels as L
from dunning.functions import text as T
from dunning.functions.money import WIDE_INT, fixed_point, money_total, prob_mean, spread_and_centre
from dunning.operators.distribution import histogram
from dunning.operators.quantile_sketch import merge_sketches, sketch_values, sketched_box
from dunning.operators.selection import exact_box
from dunning.operators.modal import label_counts, modal_label
from dunning.plans.customers import payment_history
from dunning.session import materialize

KEYS = ["customer_code", "customer_name"]
SPREAD_SCALE = 4  # fixed-point digits for the global spread of average payments


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: bounds applied, missing stays missing."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def _or_one(x: Column) -> Column:
    """Python ``x or 1`` for a number: 0 -> 1, missing stays missing."""
    return F.when(x == 0, F.lit(1)).otherwise(x)


def _segment_words(seg: Column) -> Column:
    out = F.when(seg == L.SEGMENT_WORDS[0][0], F.lit(L.SEGMENT_WORDS[0][1]))
    for label, word in L.SEGMENT_WORDS[1:]:
        out = out.when(seg == label, F.lit(word))
    return out.otherwise(F.lit("unknown risk"))


def explanation(c: dict[str, Column]) -> Column:
    """Sentence explaining a limit (F10), built from built-in functions."""
    words = {part: F.lit(text) for part, text in L.EXPLANATION.items()}
    history = F.when(c["n"] > 0, F.concat(words["history"], c["n"].cast("string"), words["payments"], T.thousands(c["avg_paid"], 2)))
    seniority = F.when(c["days_since"] > 0, F.concat(words["seniority"], c["days_since"].cast("string"), words["days"]))
    return F.concat(
        words["customer"],
        _segment_words(c["segment"]),
        words["risk"],
        T.percent_or_nan(c["p"]),
        F.lit(", "),
        history.otherwise(words["no_history"]),
        F.lit(", "),
        seniority.otherwise(words["new"]),
        F.lit(", "),
        words["behavior"],
        F.coalesce(c["status"], F.lit("nan")),
        words["average"],
        T.fixed(c["avg_days"], 0),
        words["overdue"],
        words["advice"],
        F.when(c["weight"] < 0.5, words["reduce"]).otherwise(words["keep"]),
        words["limit"],
    )


#: What the explanation is made of; kept beside the limits, dropped from results.
_FACTS = ["avg_paid", "avg_days", "days_since_last_payment", "weight"]

LIMIT_COLUMNS = [
    "customer_code",
    "customer_name",
    "risk_segment",
    "aging_status",
    "avg_probability",
    "balance",
    "total_paid",
    "payment_count",
    "credit_limit",
    "max_days",
    "explanation",
]


def with_explanation(numbers: DataFrame) -> DataFrame:
    """The limits with their explanation sentence, largest limit first."""
    text = explanation(
        {
            "n": F.col("payment_count"),
            "avg_paid": F.col("avg_paid"),
            "days_since": F.col("days_since_last_payment"),
            "status": F.col("aging_status"),
            "avg_days": F.col("avg_days"),
            "weight": F.col("weight"),
            "segment": F.col("risk_segment"),
            "p": F.col("avg_probability"),
        }
    )
    return (
        numbers.withColumn("explanation", text).select(*LIMIT_COLUMNS).orderBy(F.desc_nulls_last("credit_limit"), "customer_code")
    )


def credit_limits(st: DataFrame, pay_filled: DataFrame, as_of: dt.date, fill_missing: bool = False) -> DataFrame:
    return with_explanation(limit_numbers(st, pay_filled, as_of, fill_missing))


def limit_numbers(st: DataFrame, pay_filled: DataFrame, as_of: dt.date, fill_missing: bool = False) -> DataFrame:
    """The limits without text, for the summaries that need none."""
    keyed = st.where(F.col("customer_code").isNotNull() & F.col("customer_name").isNotNull())
    seg, status = F.col("risk_segment"), F.col("aging_status")
    # one aggregation: metrics and both modal labels (known label sets)
    base = keyed.groupBy(*KEYS).agg(
        money_total(F.col("balance")).alias("balance"),
        F.avg("days_past_due").alias("avg_days"),
        prob_mean(F.col("default_probability")).alias("avg_probability"),
        *label_counts(seg, L.SEGMENTS, "_sg"),
        *label_counts(status, L.STATUSES, "_st"),
    )
    base = base.select(
        *KEYS,
        "balance",
        "avg_days",
        "avg_probability",
        modal_label(L.SEGMENTS, "_sg").alias("risk_segment"),
        modal_label(L.STATUSES, "_st").alias("aging_status"),
    )
    hist = payment_history(pay_filled, as_of).select(
        "customer_code", "total_paid", "avg_paid", "payment_count", "days_since_last_payment"
    )
    # one row per customer; written once so the global scalars below read it cheaply
    j = materialize(base.join(hist, "customer_code", "left"))

    # all global scalars over the (already written) joined customers: one
    # aggregate job returning one row of exact integers
    u = fixed_point(F.col("avg_paid"), SPREAD_SCALE)
    g = j.agg(
        F.max("payment_count").alias("max_n"),
        F.max("days_since_last_payment").alias("max_ds"),
        F.count("avg_paid").alias("n"),
        F.sum(u).cast(WIDE_INT).alias("s1"),
        F.sum(u * u).cast(WIDE_INT).alias("s2"),
    ).first()
    spread, centre = spread_and_centre(g["n"], g["s1"], g["s2"], SPREAD_SCALE)
    max_n = F.lit(g["max_n"]).cast("long")
    max_ds = F.lit(g["max_ds"]).cast("int")
    n, avg_paid, seg, status = F.col("payment_count"), F.col("avg_paid"), F.col("risk_segment"), F.col("aging_status")
    out = j.withColumns({"_spread": F.lit(spread).cast("double"), "_centre": F.lit(centre).cast("double")})
    out = out.withColumn(
        "_h0",
        F.lit(0.5) * F.try_divide(n, max_n) + F.lit(0.5) * (F.lit(1.0) - F.try_divide(F.col("_spread"), F.col("_centre"))),
    ).withColumn("_r0", F.try_divide(F.col("days_since_last_payment"), _or_one(max_ds)))
    history_f = clip(F.col("_h0"), 0.0, 1.0)
    recency_f = clip(F.col("_r0"), 0.0, 1.0)
    if fill_missing:
        history_f = F.coalesce(history_f, F.lit(0.5))
        recency_f = F.coalesce(recency_f, F.lit(0.5))
    out = out.withColumns(
        {
            "risk_f": F.lit(1.0) - F.col("avg_probability"),
            "history_f": history_f,
            "recency_f": recency_f,
            "behaviour_f": C.behaviour_factor(F.col("avg_days")),
            "base_amount": F.when(avg_paid > 0, avg_paid).otherwise(F.col("balance")),
        }
    )
    out = out.withColumn(
        "weight",
        F.lit(0.4) * F.col("risk_f") + F.lit(0.3) * F.col("history_f") + F.lit(0.2) * F.col("recency_f") + F.lit(0.1) * F.col("behaviour_f"),
    )
    out = out.withColumn("_l0", F.col("base_amount") * (F.lit(1.0) + F.col("weight")))
    out = out.withColumn(
        "_l1", F.when(seg.isin(L.SEGMENT_HIGH, L.SEGMENT_EXTREME), F.col("_l0") * F.lit(0.5)).otherwise(F.col("_l0"))
    )
    days = (
        F.when(seg == L.SEGMENT_EXTREME, F.lit(7))
        .when(seg == L.SEGMENT_HIGH, F.lit(15))
        .when(seg == L.SEGMENT_MODERATE, F.lit(30))
        .otherwise(F.lit(60))
    )
    out = out.withColumn("credit_limit", clip(F.col("_l1"), lo=1000.0)).withColumn("_d0", days)
    out = out.withColumn(
        "max_days", F.when(F.col("avg_days") > 60, (F.col("_d0") * F.lit(0.5)).cast("int")).otherwise(F.col("_d0"))
    )
    return out.select(*[c for c in LIMIT_COLUMNS if c != "explanation"], *_FACTS)


def filter_limits(limits: DataFrame, segments=None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Segment in the set and limit in [lo, hi]; what is None filters nothing.
    Missing limits drop out of a range."""
    if segments is not None:
        limits = limits.where(F.col("risk_segment").isin(list(segments)))
    if lo is not None:
        limits = limits.where(F.col("credit_limit") >= F.lit(lo))
    return limits if hi is None else limits.where(F.col("credit_limit") <= F.lit(hi))


def limits_domain(limits: DataFrame) -> DataFrame:
    """Bounds of the limit filter widgets (segment list has <= 4 labels)."""
    return limits.agg(
        F.array_join(F.array_sort(F.collect_set("risk_segment")), "|").alias("segments"),
        F.min("credit_limit").alias("min_limit"),
        F.max("credit_limit").alias("max_limit"),
    )


def limits_summary(filtered: DataFrame) -> DataFrame:
    """Customers, mean limit (fixed-point exact) and mean maximum days."""
    lim = F.col("credit_limit")
    return filtered.agg(
        F.count(F.lit(1)).alias("customers"),
        (F.try_divide(F.sum(fixed_point(lim, 6)).cast("double"), F.count(lim)) / F.lit(1e6)).alias("avg_limit"),
        F.avg("max_days").alias("avg_max_days"),
    )


def limit_histogram(filtered: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(filtered, "credit_limit", bins)


def limits_box(limits: DataFrame, by: str = "risk_segment") -> DataFrame:
    """Box statistics of the limits by segment, exact."""
    return exact_box(limits, "credit_limit", [by], image="double")


def limits_box_sketch(limits: DataFrame) -> DataFrame:
    """Box statistics of the limits by segment, from stored sketches of each
    segment and term (maximum days)."""
    stored = materialize(sketch_values(limits, "credit_limit", ["risk_segment", "max_days"]))
    return sketched_box(merge_sketches(stored, ["risk_segment"]), ["risk_segment"])


def limit_points(filtered: DataFrame) -> DataFrame:
    """Points of the limit-vs-days chart."""
    return filtered.select("customer_code", "customer_name", "risk_segment", "max_days", "credit_limit")
