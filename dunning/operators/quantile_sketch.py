"""Mergeable quantile sketches: box statistics of any period from stored
summaries (A19, the opt-in approximation).

A KLL sketch of a group holds a bounded number of its values (a few times
``k``), however many rows the group has, and sketches merge: one for each group
and month answers for any set of months without reading the rows again.  New
months are appended; nothing that is stored changes.

Minimum, maximum and count are kept exactly beside the sketch.  A quantile's
rank is off by at most :func:`rank_error` of the group's rows (99 % of the
time); groups of fewer than ``k`` rows are exact.  :func:`measured_ranks`
holds sketches against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.operators.keys import join_small

K = 400
QUARTILES = (0.25, 0.5, 0.75)


def rank_error(k: int = K) -> float:
    """Share of a group's rows by which a quantile's rank may be off: the
    fitted 99 % bound that is published for KLL with parameter ``k``."""
    return 2.296 / k**0.9021


def sketch_values(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """A row for each group: ``by``, ``sketch``, ``n``, ``min_value``,
    ``max_value``.  Missing values are left out.  Tasks sketch what they read;
    only sketches are shuffled."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value")
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")
    )


def sketched_box(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The columns of :func:`dunning.operators.distribution.box_summary`, with
    quartiles that are values of the group, and an estimated number of
    outliers."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in QUARTILES]))
    out = sketches.withColumn("_q", q).select("*", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    out = out.withColumn("lower_fence", F.col("q1") - F.lit(1.5) * iqr).withColumn("upper_fence", F.col("q3") + F.lit(1.5) * iqr)
    # the sketch's ranks of the fences, to 1 / K: how many of its K-quantiles lie outside
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit((i + 0.5) / K) for i in range(K)]))
    out = out.withColumn("_g", F.filter(grid, lambda v: (v < F.col("lower_fence")) | (v > F.col("upper_fence"))))
    outside = F.round(F.col("n") * F.size("_g") / F.lit(float(K))).cast("long")
    return out.withColumn("outliers", outside).select(*by, "min_value", "q1", "median", "q3", "max_value", "n", "lower_fence", "upper_fence", "outliers")


def measured_ranks(df: DataFrame, value: str, by: list[str], boxes: DataFrame) -> DataFrame:
    """By how much the rank of each quartile of ``boxes`` is off, as a share of
    the group's rows: ``by``, ``q1_error``, ``median_error``, ``q3_error``.
    0 where the wanted rank lies among the rows equal to the value."""
    v = F.col(value).cast("double")
    names = ("q1", "median", "q3")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    counts = []
    for c in names:
        counts += [F.sum((F.col("_v") < F.col(c)).cast("long")).alias(f"_{c}_below"), F.sum((F.col("_v") <= F.col(c)).cast("long")).alias(f"_{c}_upto")]
    met = join_small(rows, boxes.select(*by, *names), by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *counts)

    def off(c: str, p: float):
        below, upto = F.col(f"_{c}_below") / F.col("_n"), F.col(f"_{c}_upto") / F.col("_n")
        return F.greatest(below - p, p - upto, F.lit(0.0))

    return met.select(*by, *[off(c, p).alias(f"{c}_error") for c, p in zip(names, QUARTILES, strict=True)])
