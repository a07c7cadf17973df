"""Global running totals in a total order (W3) and the greedy goal cut (K1),
from a running total of all rows or (:func:`rows_to_goal`) without one.

A plain ``sum(...).over(Window.orderBy(...))`` has no partition key, so Spark
plans ``Exchange SinglePartition``: every row goes through one task.  Instead:

1. ``repartitionByRange`` on the full order key.  The range bounds come from a
   sample of the *composite* key, so even a value shared by a third of all
   rows is split over many partitions by the tie-break columns.  Without an
   explicit partition count AQE may coalesce the ranges to its advisory size;
   it only ever merges *adjacent* ranges, so partition order stays the key
   order.
2. ``sortWithinPartitions`` + one Arrow pass per partition computes the local
   prefix sums (vectorised ``cumulative_sum``; the carry crosses batches).
3. The result is written to the shared folder: partition labels are then
   fixed, and a lost executor cannot re-derive them
   differently.
4. Per-partition totals (one row per partition, so bounded by the partition
   count) get an exclusive prefix and are broadcast back by partition label.

Values are integers (cents, counts), so every running total is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from dunning.session import materialize

_PART, _CUM, _POS, _VAL = "_rt_part", "_rt_cum", "_rt_pos", "_rt_val"


def running_total(
    df: DataFrame,
    order: list[Column],
    value: Column,
    out: str,
    position: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = inclusive running sum of the integer ``value`` in ``order``
    (which must be a total order), and optionally the 1-based ``position``."""
    # defined here so that it travels to the workers by value: they need not have this package
    names = (_VAL, _PART, _CUM, _POS)

    def prefix_sums(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carry, seen = 0, 0
        for batch in batches:
            n = batch.num_rows
            vals = pc.fill_null(batch.column(names[0]), 0)
            # checked arithmetic: an int64 overflow raises instead of wrapping
            cum = pc.add_checked(pc.cumulative_sum_checked(vals), pa.scalar(carry, pa.int64())) if n else pa.array([], pa.int64())
            pos = pa.array(np.arange(seen + 1, seen + n + 1, dtype=np.int64))
            if n:
                carry = cum[-1].as_py()
            seen += n
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(np.full(n, part, dtype=np.int32)), cum, pos],
                names=list(batch.schema.names) + list(names[1:]),
            )

    staged = df.withColumn(_VAL, value.cast("long"))
    if num_partitions:
        ranged = staged.repartitionByRange(num_partitions, *order)
    else:
        ranged = staged.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    schema = StructType(
        list(ranged.schema.fields)
        + [
            StructField(_PART, IntegerType(), False),
            StructField(_CUM, LongType(), True),
            StructField(_POS, LongType(), False),
        ]
    )
    local = materialize(ranged.mapInArrow(prefix_sums, schema))
    totals = local.groupBy(_PART).agg(
        F.coalesce(F.sum(_VAL), F.lit(0)).alias("_rt_tot"), F.count(F.lit(1)).alias("_rt_cnt")
    )
    # one row per range partition: the single-partition window here is bounded
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PART,
        F.coalesce(F.sum("_rt_tot").over(before), F.lit(0)).alias("_rt_off"),
        F.coalesce(F.sum("_rt_cnt").over(before), F.lit(0)).alias("_rt_posoff"),
    )
    res = local.join(F.broadcast(offsets), _PART).withColumn(out, F.col("_rt_off") + F.col(_CUM))
    if position:
        res = res.withColumn(position, F.col("_rt_posoff") + F.col(_POS))
    return res.drop(_PART, _CUM, _POS, _VAL, "_rt_off", "_rt_posoff")


def select_to_goal(ranked: DataFrame, goal: float, cum: str, position: str) -> DataFrame:
    """Greedy walk in ``position`` order that stops *after* the first row at
    which the running total ``cum`` reaches ``goal``.

    The cut is the smallest position with ``cum >= goal`` (a one-row scalar
    subquery); rows up to it are kept.  Exact with negative amounts, where
    "prior total < goal" alone is not.  goal <= 0 keeps nothing; a goal that is
    never reached keeps everything.
    """
    if goal <= 0:
        return ranked.where(F.lit(False))
    cut = ranked.where(F.col(cum) >= F.lit(goal)).select(F.min(position)).scalar()
    return ranked.where(F.col(position) <= F.coalesce(cut, F.lit(2**62)))


#: Bins of a pass over the scores, and rows of a bin that are sorted at once.
GOAL_BINS, GOAL_ROWS = 4096, 1_000_000


def rows_to_goal(df: DataFrame, score: str, ties: list[str], cents: str, goal: float) -> DataFrame:
    """The rows that :func:`select_to_goal` keeps in the order ``score``
    descending (nulls last), ``ties`` ascending, without ordering all rows.

    A pass adds up each score bin's amounts and, apart, its positive amounts.
    Both combine in any order, and no prefix of a bin can exceed its positive
    sum; so a bin can hold the cut only if what lies before it plus its
    positive sum reaches the goal.  Only such a bin is looked into: binned
    again, and once it is small or one score, ordered by a running total of its
    own.  Exact with negative amounts, where such a bin may turn out not to
    reach the goal and the search goes on behind it.  The cut becomes a filter
    on the order key, so no other row is ever moved.

    ``df`` is read several times: pass a written table.
    """
    if goal <= 0:
        return df.where(F.lit(False))
    cut = _goal_cut(df, score, ties, cents, goal, 0)[0]
    if cut is None:
        return df
    s = F.col(score)
    same = s.eqNullSafe(F.lit(cut[score]).cast(df.schema[score].dataType))
    before = F.lit(True)
    for c in reversed(ties):  # up to the cut's ties, lexicographically
        key = F.lit(cut[c])
        before = (F.col(c) < key) | ((F.col(c) == key) & before)
    ahead = s.isNotNull() if cut[score] is None else F.coalesce(s > F.lit(cut[score]), F.lit(False))
    return df.where(ahead | (same & before))


def _goal_cut(rows: DataFrame, score: str, ties: list[str], cents: str, goal: float, before: int):
    """(key of the row at which the running total from ``before`` on reaches
    ``goal``, or None; total behind all rows)."""
    s = F.col(score)
    ends = rows.agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = ends["lo"], ends["hi"]
    scale = GOAL_BINS / (hi - lo) if lo is not None and lo < hi and hi - lo > 1e-290 else 0.0
    if ends["n"] <= GOAL_ROWS or not scale:
        order = [F.desc_nulls_last(score), *[F.asc(c) for c in ties]]
        ranked = running_total(rows.select(score, *ties, cents), order, F.col(cents), "_goal_cum", position="_goal_pos")
        hit = ranked.where((F.col("_goal_cum") + F.lit(before)).cast("double") / F.lit(100.0) >= F.lit(goal))
        first = hit.agg(F.min(F.struct("_goal_pos", score, *ties)).alias("at")).first()["at"]
        total = rows.agg(F.coalesce(F.sum(cents), F.lit(0)).alias("t")).first()["t"]
        return first, before + total
    # falls as the score rises, and never the other way round: rounding is monotone
    bin_of = F.coalesce(F.least(F.floor((F.lit(hi) - s) * F.lit(scale)).cast("int"), F.lit(GOAL_BINS - 1)), F.lit(GOAL_BINS))
    sums = rows.groupBy(bin_of.alias("bin")).agg(F.coalesce(F.sum(cents), F.lit(0)).alias("sum"), F.coalesce(F.sum(F.greatest(cents, F.lit(0))), F.lit(0)).alias("most"))
    for b in sorted(sums.collect()):  # at most GOAL_BINS + 1 rows
        if (before + b["most"]) / 100.0 >= goal:
            cut, after = _goal_cut(rows.where(bin_of == b["bin"]), score, ties, cents, goal, before)
            if cut is not None:
                return cut, after
        before += b["sum"]
    return None, before

