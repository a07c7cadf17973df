"""Exact order statistics of many groups by radix refinement (A19 for values
with many different ones, such as amounts and limits).

Values become integers in the same order.  A pass counts rows by (group, next
12 bits) among the rows that still can hold a wanted rank: map tasks add up
their counts, so at most 4096 counts for each wanted prefix and task are
shuffled and no row is.  The ranks then pick their bits, and the next pass looks
only at rows with these.  32-bit cents take three passes, any double six.
There is no list of values, no sort, and no row that grows with the number of
different values; a value that a third of all rows share is a count like any
other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunning.functions.money import money
from dunning.operators.keys import join_on, join_small
from dunning.session import materialize

BITS = 12
LOWEST = -(1 << 63)


def cents(c: Column) -> Column:
    """Money as a whole number of cents."""
    return (money(c) * 100).cast("long")


def from_cents(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def double_image(c: Column) -> Column:
    """A long in the order of the doubles (NaN and null: null)."""
    c = F.when(~F.isnan(c), c + F.lit(0.0))  # -0.0 becomes 0.0
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c).cast("long")
    return F.when(c.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def from_double_image(c: Column) -> Column:
    bits = F.when(c < 0, c.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(c)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


#: How values become longs and back.
IMAGES = {"money": (cents, from_cents), "double": (lambda c: double_image(c.cast("double")), from_double_image), "whole": (lambda c: c.cast("long"), lambda c: c.cast("double"))}


def select_ranks(rows: DataFrame, image: str, by: list[str], ranks: DataFrame) -> DataFrame:
    """``ranks`` (``by`` and the 0-based ``rank``, any number for each group)
    with ``found``: the image at that place of the group's order."""
    ends = rows.agg(F.min(image).alias("lo"), F.max(image).alias("hi")).first()
    if ends["lo"] is None:
        return ranks.withColumn("found", F.lit(None).cast("long")).where(F.lit(False))
    lo, width = ends["lo"], ends["hi"] - ends["lo"]
    # distance to the smallest, or, where no long holds that, all 64 bits with the sign flipped
    rel = F.col(image) - F.lit(lo) if width < 1 << 63 else F.col(image).bitwiseXOR(F.lit(LOWEST))
    passes = max(-(-width.bit_length() // BITS), 1) if width < 1 << 63 else -(-64 // BITS)
    rows = rows.select(*by, rel.alias("_rel"))
    wanted = ranks.select(*by, "rank").distinct().withColumns({"_prefix": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")})
    key = [*by, "_prefix"]
    for i in range(passes - 1, -1, -1):
        shift = BITS * i
        digit = F.shiftrightunsigned("_rel", shift).bitwiseAND((1 << BITS) - 1)
        counts = rows.withColumn("_prefix", F.lit(0).cast("long")) if i == passes - 1 else rows
        counts = counts.groupBy(*key, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy(*key).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        place = F.col("rank") - F.col("_below")
        hit = (place >= F.col("_before")) & (place < F.col("_before") + F.col("_n"))
        # both sides hold a few rows for each prefix: no row of the input
        wanted = join_on(wanted, counts, key).where(hit).select(
            *by,
            "rank",
            F.shiftleft("_prefix", BITS).bitwiseOR(F.col("_digit")).alias("_prefix"),
            (F.col("_below") + F.col("_before")).alias("_below"),
        )
        wanted = materialize(wanted)
        if i:  # what can still be a wanted value goes on
            rows = rows.drop("_prefix").withColumn("_prefix", F.shiftrightunsigned("_rel", shift))
            rows = materialize(join_small(rows, wanted.select(*key).distinct(), key, "left_semi"))
    value = F.col("_prefix") + F.lit(lo) if width < 1 << 63 else F.col("_prefix").bitwiseXOR(F.lit(LOWEST))
    return wanted.select(*by, "rank", value.alias("found"))


def exact_box(df: DataFrame, value: str, by: list[str] | None = None, image: str = "double") -> DataFrame:
    """The columns of :func:`dunning.operators.distribution.box_summary`, for
    values with any number of different ones.  ``image`` is ``money`` (cents),
    ``whole`` or ``double``.  Missing values are left out; quartiles
    interpolate linearly; a group without values has no row."""
    if not by:
        return exact_box(df.withColumn("_all", F.lit(0)), value, ["_all"], image).drop("_all")
    there, back = IMAGES[image]
    rows = materialize(df.select(*by, there(F.col(value)).alias("_image")).where(F.col("_image").isNotNull()))
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_image").alias("_lo"), F.max("_image").alias("_hi")))
    places = {c: (F.col("n") - 1) * F.lit(p) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    ranks = sizes.select(*by, F.explode(F.array(*[f(x).cast("long") for x in places.values() for f in (F.floor, F.ceil)])).alias("rank"))
    found = select_ranks(rows, "_image", by, ranks.distinct())
    # at most six ranks a group, as a map
    found = found.withColumn("v", back(F.col("found"))).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    box = join_on(sizes, found, by)

    def quartile(x: Column) -> Column:
        a, b = (F.element_at("_at", f(x).cast("long")) for f in (F.floor, F.ceil))
        return a + (b - a) * (x - F.floor(x))

    box = box.withColumns({c: quartile(x) for c, x in places.items()})
    iqr = F.col("q3") - F.col("q1")
    box = materialize(
        box.select(
            *by,
            back(F.col("_lo")).alias("min_value"),
            "q1",
            "median",
            "q3",
            back(F.col("_hi")).alias("max_value"),
            "n",
            (F.col("q1") - F.lit(1.5) * iqr).alias("lower_fence"),
            (F.col("q3") + F.lit(1.5) * iqr).alias("upper_fence"),
        )
    )
    valued = rows.select(*by, back(F.col("_image")).alias("_v"))
    outside = join_small(valued, box.select(*by, "lower_fence", "upper_fence"), by)
    outside = outside.where((F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence")))
    outside = outside.groupBy(*by).agg(F.count(F.lit(1)).alias("_outliers"))
    return join_on(box, outside, by, "left").select(*box.columns, F.coalesce("_outliers", F.lit(0)).alias("outliers"))
