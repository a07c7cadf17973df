"""Distribution summaries: box statistics (A19), equal-width histogram
and an exact median (M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunning.operators.running import running_total


def box_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, q1, median, q3, max, 1.5*IQR fences and outlier count per group.

    One pass over the rows: they are counted by (group, value), with partial
    counts before the shuffle, and all statistics come from the counts.  That
    suits values with few different ones, such as days past due; a group's
    buffer holds one entry for each of its different values.  Quartiles
    interpolate linearly.
    """
    by = by or []
    v = F.col("_v")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.groupBy(*by).agg(
        F.min(v).cast("double").alias("min_value"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("_q"),
        F.max(v).cast("double").alias("max_value"),
        F.sum("_n").alias("n"),
        F.collect_list(F.struct("_v", "_n")).alias("_counts"),
    )
    iqr = F.col("q3") - F.col("q1")
    outside = lambda x: (x["_v"] < F.col("lower_fence")) | (x["_v"] > F.col("upper_fence"))
    outliers = F.aggregate(F.filter("_counts", outside), F.lit(0).cast("long"), lambda total, x: total + x["_n"])
    out = (
        stats.select("*", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
        .withColumn("lower_fence", F.col("q1") - F.lit(1.5) * iqr)
        .withColumn("upper_fence", F.col("q3") + F.lit(1.5) * iqr)
        .withColumn("outliers", outliers)
    )
    columns = [*by, "min_value", "q1", "median", "q3", "max_value", "n", "lower_fence", "upper_fence", "outliers"]
    return out.where("n is not null").select(*columns)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the max falls in the last bin; empty
    bins are emitted with count 0."""
    v = F.col(value)
    rows = df.where(v.isNotNull())
    stats = rows.agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi"))
    bounds = stats.select(F.struct("lo", "hi")).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    bin_of = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / width).cast("int"), F.lit(bins - 1))
    )
    counts = rows.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = stats.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi").select(
        "bin",
        (F.col("lo") + F.col("bin") * ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))).alias("bin_end"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count")
    )


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact medians of several columns from ONE distributed sort.

    The columns are stacked into (column index, value) rows and ranked by a
    single running total on (column, value, row hash); a column's positions
    start after the rows of the columns before it.  The two middle values are
    interpolated linearly.  Returns one row per column: ``(_ci, median)``.
    A hash of the whole row breaks value ties, so even one value shared by a
    third of all rows is split over many range partitions."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_mt")
    pairs = F.array(*[F.struct(F.lit(i).alias("_ci"), F.col(c).cast("double").alias("_mv")) for i, c in enumerate(cols)])
    stacked = df.select(F.inline(pairs), tie).where(F.col("_mv").isNotNull())
    ranked = running_total(stacked, [F.asc("_ci"), F.asc("_mv"), F.asc("_mt")], F.lit(0), "_mz", position="_mp")
    # one row per column: its row count and where its positions start
    sizes = ranked.groupBy("_ci").agg(F.count(F.lit(1)).alias("_n"), F.min("_mp").alias("_start"))
    wanted = sizes.select(
        "_ci",
        (F.col("_start") - 1 + F.floor((F.col("_n") + 1) / 2)).alias("_k1"),
        (F.col("_start") - 1 + F.ceil((F.col("_n") + 1) / 2)).alias("_k2"),
    )
    mid = (
        ranked.join(F.broadcast(wanted), "_ci")  # one row per column: bounded
        .where((F.col("_mp") == F.col("_k1")) | (F.col("_mp") == F.col("_k2")))
        .groupBy("_ci")
        .agg(F.min("_mv").alias("a"), F.max("_mv").alias("b"))
    )
    return mid.select("_ci", (F.col("a") + F.lit(0.5) * (F.col("b") - F.col("a"))).alias("median"))


def exact_median(df: DataFrame, value: Column) -> Column:
    """Exact median of one column as a scalar-subquery Column.  The other
    columns of the row break ties of the value."""
    return exact_medians(df.withColumn("_x", value), ["_x"]).select("median").scalar()
