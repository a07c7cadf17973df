"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_period(d: Column) -> Column:
    """``yyyy-MM``; a missing date is its own ``NaT`` group (pandas behaviour)."""
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit("NaT"))


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def weekday_index(d: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(d)


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def dmy(d: Column) -> Column:
    """``dd/MM/yyyy``."""
    return F.date_format(d, "dd/MM/yyyy")
