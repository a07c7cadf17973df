"""A stored layout by customer: bucketed, sorted tables whose joins and
aggregations by customer need no exchange.

Statement and payments are dealt once, by customer, into the same number of
buckets.  Every report that adds up one table by customer, or joins the two,
then reads matching buckets side by side; what it would have shuffled, twice
for each report, stays where it is.  Per-customer tables that a report writes
on the way (:func:`dunning.session.materialize_by`) keep the layout.

A bucket is read by one task, so the layout is for tables in which no customer
holds much more than a bucket's share of the rows.  :func:`store_by_customer`
counts first and leaves a table as it is otherwise.  Rows without a customer
are dealt by their content: no report joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.session import bucketed, materialize

KEY = "customer_code"
#: Times a bucket's mean share that one customer may hold.
MOST_SHARES = 4.0


def largest_share(df: DataFrame, key: str = KEY) -> float:
    """Share of the keyed rows that the largest customer holds."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = per.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return top["most"] / top["all"] if top["all"] else 0.0


def store_by_customer(df: DataFrame, buckets: int, key: str = KEY) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key`` in the shared folder;
    written without buckets if one customer is too large for them."""
    written = materialize(df)  # read once, counted and dealt from files
    if largest_share(written, key) * buckets > MOST_SHARES:
        return written
    return bucketed(written.repartition(buckets, key), buckets, key)
