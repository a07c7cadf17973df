"""Modal value per group with a deterministic tie rule.

``mode()`` leaves ties unspecified; here the most frequent value wins and a
tie goes to the lowest ``rank`` (least severe label).  Two partial
aggregations: counts per (keys, value), then ``max_by`` per keys -- both with
map-side combine, so a hot key costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modal_by_rank(df: DataFrame, keys: list[str], value: Column, rank: Column, out: str) -> DataFrame:
    counts = (
        df.where(value.isNotNull())
        .groupBy(*keys, value.alias("_mv"), rank.alias("_mr"))
        .agg(F.count(F.lit(1)).alias("_mc"))
    )
    return counts.groupBy(*keys).agg(
        F.max_by("_mv", F.struct(F.col("_mc"), F.coalesce(-F.col("_mr"), F.lit(-(2**30))))).alias(out)
    )


#: Where a row stands in its input: columns that readers add when asked to.
ROW_ORDER = ("_file", "_row")


def any_name(name: Column, df: DataFrame | None = None) -> Column:
    """The first name in row order, if ``df`` knows it (:data:`ROW_ORDER`, as
    :func:`dunning.sources.ingest.with_row_order` adds it); else the smallest,
    which does not depend on the order either.  Missing names do not count."""
    if df is not None and all(c in df.columns for c in ROW_ORDER):
        return F.min_by(name, F.when(name.isNotNull(), F.struct(*ROW_ORDER)))
    return F.min(name)


def label_counts(value: Column, labels, prefix: str) -> list[Column]:
    """Aggregates counting each label of a known, small label set."""
    return [F.count(F.when(value == lab, F.lit(1))).alias(f"{prefix}{i}") for i, lab in enumerate(labels)]


def modal_label(labels, prefix: str) -> Column:
    """The most frequent label from :func:`label_counts` columns; ties go to
    the earlier (less severe) label; NULL when every count is 0.

    With the label domain known, the mode needs no extra shuffle: it rides
    along in the same aggregation as the other per-customer metrics."""
    cands = [
        F.when(F.col(f"{prefix}{i}") > 0, F.struct(F.col(f"{prefix}{i}").alias("c"), F.lit(-i).alias("r"), F.lit(lab).alias("v")))
        for i, lab in enumerate(labels)
    ]
    return F.greatest(*cands).getField("v")
