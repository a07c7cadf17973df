"""Exact aggregation helpers.

Money is summed as ``decimal(18,2)`` (the sum widens to ``decimal(28,2)``, so
it cannot overflow at any realistic scale) and turned into a double once at
the end.  Means divide that exact sum by the count.  Probabilities use
``decimal(18,6)``.  Because every floating value is produced by the same IEEE
operations on exactly-equal inputs, results do not depend on partitioning or
row order (a plain ``sum`` of doubles does).

Spread statistics (std) are computed from exact integer power sums of a
fixed-point image of the value: ``n*S2 - S1^2`` is exact, and a single
conversion to double follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)
PROB = DecimalType(18, 6)
WIDE_INT = DecimalType(38, 0)

#: Amounts reach up to here: a double still holds cents, and DECIMAL(18,2) the
#: value.  What is larger, infinite or NaN is no amount and counts as missing.
MOST = 1e15


def in_range(c: Column) -> Column:
    return F.when(F.abs(c) < MOST, c)


def money(c: Column) -> Column:
    return in_range(c).cast(MONEY)


def money_sum(c: Column) -> Column:
    """Exact sum as decimal (NULL for an empty / all-NULL group)."""
    return F.sum(money(c))


def as_double(c: Column) -> Column:
    return c.cast("double")


def money_total(c: Column) -> Column:
    """Sum as double; an all-NULL group sums to 0 like pandas."""
    return F.coalesce(money_sum(c).cast("double"), F.lit(0.0))


def money_mean(c: Column) -> Column:
    """Mean of a money column, NULLs skipped; NULL for an empty group."""
    return F.try_divide(money_sum(c).cast("double"), F.count(c))


def prob_mean(c: Column) -> Column:
    return F.try_divide(F.sum(c.cast(PROB)).cast("double"), F.count(c))


def fixed_point(c: Column, scale: int) -> Column:
    """round(c * 10^scale) as an exact wide integer."""
    return F.round(in_range(c) * F.lit(float(10**scale))).cast(WIDE_INT)


def spread_numerator(n: Column, s1: Column, s2: Column) -> Column:
    """n*S2 - S1^2 as double: exact where 38 digits hold it, else from doubles."""
    wide = lambda a, b: F.try_multiply(a.cast(WIDE_INT), b.cast(WIDE_INT))
    exact = F.try_subtract(wide(n, s2), wide(s1, s1)).cast("double")
    return F.coalesce(exact, n.cast("double") * s2.cast("double") - s1.cast("double") * s1.cast("double"))


def spread_and_centre(n, s1, s2, scale: int, ddof: int = 1):
    """Standard deviation and mean from exact integer power sums of a
    fixed-point image, on the driver: ``n*S2 - S1^2`` is exact in Python
    integers of any size, and the remaining IEEE steps (int->double, divide,
    sqrt, divide) are those of the SQL oracle, so the doubles are
    bit-identical.  ``None`` when undefined."""
    if not n:
        return None, None
    n, s1, s2 = int(n), int(s1), int(s2)
    centre = float(s1) / float(n) / float(10**scale)
    if n <= ddof:
        return None, centre
    var = float(n * s2 - s1 * s1) / float(n * (n - ddof))
    return math.sqrt(max(var, 0.0)) / float(10**scale), centre


def sample_std(n: Column, s1: Column, s2: Column, scale: int) -> Column:
    """Sample standard deviation from power sums; NULL when n < 2."""
    var = F.try_divide(spread_numerator(n, s1, s2), (n * (n - 1)).cast("double"))
    return F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))) / F.lit(float(10**scale)))
