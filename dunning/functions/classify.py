"""Per-row classification rules: days past due, aging class, rule score,
risk segment, behaviour factor.  All are chained ``when`` expressions, so they
stay inside whole-stage codegen.

A NULL ``days_past_due`` falls through every comparison to the ``otherwise``
branch, which matches the reference's NaN behaviour (NaN compares False).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunning.functions import labels as L


def days_past_due(due_date: Column, as_of: dt.date) -> Column:
    """Whole days from ``due_date`` to ``as_of`` (negative when not yet due)."""
    return F.datediff(F.lit(as_of), due_date)


def aging_status(days: Column) -> Column:
    return (
        F.when(days > 120, L.STATUS_SEVERE)
        .when(days > 90, L.STATUS_HIGH)
        .when(days > 60, L.STATUS_MODERATE)
        .when(days > 30, L.STATUS_EARLY)
        .otherwise(L.STATUS_CURRENT)
    )


def status_rank(status: Column) -> Column:
    """0 (current) .. 4 (severe); NULL for unknown labels."""
    out = F.when(status == L.STATUSES[0], F.lit(0))
    for i, label in enumerate(L.STATUSES[1:], start=1):
        out = out.when(status == label, F.lit(i))
    return out


def rule_probability(days: Column) -> Column:
    """Deterministic default probability used when no model is trained."""
    return (
        F.when(days > 60, F.lit(0.85))
        .when(days > 30, F.lit(0.5))
        .when(days > 15, F.lit(0.3))
        .otherwise(F.lit(0.1))
    )


def risk_segment(p: Column, include_lowest: bool = True) -> Column:
    """Right-closed bins (0, .3], (.3, .6], (.6, .8], (.8, 1].

    ``include_lowest`` also puts exactly 0 in the lowest bin (the model path);
    the rule fallback leaves it out. Outside [0, 1] or NULL -> NULL.
    """
    low = (p >= 0) & (p <= 0.3) if include_lowest else (p > 0) & (p <= 0.3)
    return (
        F.when(low, L.SEGMENT_LOW)
        .when((p > 0.3) & (p <= 0.6), L.SEGMENT_MODERATE)
        .when((p > 0.6) & (p <= 0.8), L.SEGMENT_HIGH)
        .when((p > 0.8) & (p <= 1.0), L.SEGMENT_EXTREME)
    )


def segment_rank(segment: Column) -> Column:
    out = F.when(segment == L.SEGMENTS[0], F.lit(0))
    for i, label in enumerate(L.SEGMENTS[1:], start=1):
        out = out.when(segment == label, F.lit(i))
    return out


def behaviour_factor(days: Column) -> Column:
    """Credit-limit behaviour factor from mean days past due."""
    return (
        F.when(days > 90, F.lit(0.1))
        .when(days > 60, F.lit(0.3))
        .when(days > 30, F.lit(0.6))
        .when(days > 15, F.lit(0.8))
        .otherwise(F.lit(1.0))
    )


def aging_columns(status: Column, balance: Column) -> dict[str, Column]:
    """The five aging buckets: the balance in the row's own class, else 0."""
    out = {}
    for (name, _), label in zip(L.AGING_BUCKETS, L.STATUSES):
        out[name] = F.when(status == label, balance).otherwise(F.lit(0.0))
    return out
