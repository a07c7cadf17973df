"""Text formatting that reproduces Python's format-spec output with built-ins.

``format_number`` rounds half-even on the exact binary value, like Python's
``format``; ``format_string('%.0f')`` does not, so it is never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column, decimals: int) -> Column:
    """Python ``{:,.Nf}``."""
    return F.format_number(c, decimals)


def fixed(c: Column, decimals: int) -> Column:
    """Python ``{:.Nf}`` (no thousands separators); NULL -> 'nan'."""
    return F.coalesce(F.regexp_replace(F.format_number(c, decimals), ",", ""), F.lit("nan"))


def _text_passes(c: Column, shown) -> Column:
    """``shown`` of a text column's number; text that is no number stays."""
    number = c.try_cast("double")
    return F.when(c.isNotNull() & number.isNull(), c).otherwise(shown(number))


def fmt_currency(c: Column, text: bool = False) -> Column:
    """``$1,234.50``; whole numbers without decimals; NULL -> ``N/A``.  With
    ``text`` the column is text, and what is no number passes through."""
    if text:
        return _text_passes(c, fmt_currency)
    whole = (c % 1) == 0
    return (
        F.when(c.isNull() | F.isnan(c), F.lit("N/A"))
        .when(whole, F.concat(F.lit("$"), F.format_number(c, 0)))
        .otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))
    )


def fmt_percent(c: Column, text: bool = False) -> Column:
    """``12.3%``; NULL -> ``N/A``; ``text`` as in :func:`fmt_currency`."""
    if text:
        return _text_passes(c, fmt_percent)
    return F.when(c.isNull() | F.isnan(c), F.lit("N/A")).otherwise(
        F.concat(F.regexp_replace(F.format_number(c * F.lit(100.0), 1), ",", ""), F.lit("%"))
    )


def percent_or_nan(c: Column) -> Column:
    """Python ``f"{v:.1%}"`` where NaN prints as ``nan%``."""
    return F.concat(fixed(c * F.lit(100.0), 1), F.lit("%"))
