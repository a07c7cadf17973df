"""Evaluation of scores against labels: area under the curve, Brier score and
calibration, for any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.functions.money import PROB
from dunning.operators.running import running_total

WIDE = "decimal(38,0)"


def score_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A row for each different score: ``score``, ``positives``, ``negatives``
    and ``negatives_below``, the negatives with a smaller score.

    Ties are added up before anything is ordered, so a score that a third of
    all rows share is one row; the distinct scores get a distributed running
    total.  Rows without a score or a label are left out.
    """
    y = F.col(label).cast("int")
    rows = df.where(F.col(score).isNotNull() & y.isNotNull())
    per = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("positives"), F.count_if(y != 1).alias("negatives"))
    ranked = running_total(per, [F.asc("score")], F.col("negatives"), "_upto")
    return ranked.select("score", "positives", "negatives", (F.col("_upto") - F.col("negatives")).alias("negatives_below"))


def evaluate(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ``rows``, ``positives``, ``auc``, ``brier`` and ``accuracy``
    (score above one half).

    The area is the share of (positive, negative) pairs that the score orders
    rightly, a tie counting half: the rank statistic with tied mid-ranks, from
    exact integers.  Null where one class is missing.
    """
    pairs = F.col("positives").cast(WIDE) * (2 * F.col("negatives_below") + F.col("negatives")).cast("decimal(20,0)")
    curve = score_curve(df, score, label).agg(
        F.sum(F.col("positives") + F.col("negatives")).alias("rows"), F.sum("positives").alias("positives"), F.sum("negatives").alias("_n"), F.sum(pairs).cast("double").alias("_pairs")
    )
    y = F.col(label).cast("int")
    off = F.col(score).cast(PROB) - F.when(y == 1, F.lit(1)).otherwise(F.lit(0)).cast("decimal(6,0)")
    rest = df.where(F.col(score).isNotNull() & y.isNotNull()).agg(
        F.sum((off * off).cast("decimal(20,12)")).cast("double").alias("_off"), F.count_if((F.col(score) > 0.5) == (y == 1)).alias("_right")
    )
    both = rest.select(F.struct("_off", "_right")).scalar()
    n = F.col("rows").cast("double")
    area = F.try_divide(F.col("_pairs"), F.lit(2.0) * F.col("positives").cast("double") * F.col("_n").cast("double"))
    return curve.select(
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        area.alias("auc"),
        F.try_divide(both.getField("_off"), n).alias("brier"),
        F.try_divide(both.getField("_right").cast("double"), n).alias("accuracy"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of positives in each of ``bins`` equal score
    ranges that has rows; 1 belongs to the last."""
    y = F.col(label).cast("int")
    at = F.least(F.floor(F.col(score) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    rows = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(at.alias("bin"))
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(score).cast(PROB)).cast("double").alias("_p"), F.count_if(y == 1).alias("_y"))
    return out.select("bin", "rows", (F.col("_p") / F.col("rows")).alias("mean_score"), (F.col("_y") / F.col("rows")).alias("positive_share"))
