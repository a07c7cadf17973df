"""Classified and scored statement, and the two payment views.

``payments`` keeps NULL amounts (only the payment statistics read it);
``payments_filled`` has the five amounts NULL -> 0, which is what every later
report area of the reference sees.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.functions import classify as C

FILLED_AMOUNTS = ("paid_amount", "cash", "cheque", "card", "transfer")


def classify(st: DataFrame, as_of: dt.date) -> DataFrame:
    """Days past due (unless given), aging class, and the five aging buckets."""
    if "days_past_due" not in st.columns:
        st = st.withColumn("days_past_due", C.days_past_due(F.col("due_date"), as_of))
    st = st.withColumn("aging_status", C.aging_status(F.col("days_past_due")))
    buckets = {k: v for k, v in C.aging_columns(F.col("aging_status"), F.col("balance")).items() if k not in st.columns}
    return st.withColumns(buckets)


def score_rules(st: DataFrame) -> DataFrame:
    """Rule score and the rule path's segmentation (exactly 0 is not binned)."""
    st = st.withColumn("default_probability", C.rule_probability(F.col("days_past_due")))
    return st.withColumn("risk_segment", C.risk_segment(F.col("default_probability"), include_lowest=False))


def score(st: DataFrame, mode: str = "auto", seed: int = 42) -> DataFrame:
    """``rules`` | ``model`` | ``auto`` (model unless its training rows have one class)."""
    if mode == "rules":
        return score_rules(st)
    from dunning.plans import ml

    if mode == "auto" and not ml.has_two_classes(st):
        return score_rules(st)
    model = ml.fit_risk_model(st, seed=seed)
    return ml.score_model(st, model)


def prepare_statement(st: DataFrame, as_of: dt.date, mode: str = "auto") -> DataFrame:
    return score(classify(st, as_of), mode)


def fill_payments(pay: DataFrame) -> DataFrame:
    present = [c for c in FILLED_AMOUNTS if c in pay.columns]
    return pay.na.fill(0.0, subset=present)
