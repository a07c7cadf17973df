"""The largest sums by key among very many keys (T1, T2) without a shuffle of
all keys.

1. Each task keeps a weighted Misra-Gries summary of the positive amounts it
   reads: at most ``2 * capacity`` keys; when more arrive, the ``capacity``
   largest stay, less what the next one has.  A key's true positive total is at
   most its kept weight plus what the task took off, and the summaries add up:
   over all tasks no more than total / capacity is missing.
2. The keys with the largest merged weights are candidates; a second pass adds
   up only these, exactly, negative amounts included.
3. The certificate: a key that is no candidate has at most the largest weight
   left out plus all that was taken off.  If the n-th exact sum is larger, no
   other key can be among the first n, whatever its negative amounts.  If not,
   the keys are aggregated plainly: the result is exact either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.session import materialize

CAPACITY = 4096


def summaries(df: DataFrame, key: str, cents: str, capacity: int) -> DataFrame:
    """``key`` and ``weight`` from each task, and with a null key what the task
    took off."""

    def task(batches):  # travels by value
        import pyarrow as pa
        import pyarrow.compute as pc

        held, off = None, 0
        for batch in batches:
            tables = [pa.Table.from_batches([batch])] if held is None else [held, pa.Table.from_batches([batch])]
            per = pa.concat_tables(tables).group_by("k").aggregate([("w", "sum")])
            held = pa.table({"k": per.column("k"), "w": per.column("w_sum")})
            if held.num_rows > 2 * capacity:
                held = held.sort_by([("w", "descending")])
                less = held.column("w")[capacity].as_py()
                off += less
                held = held.slice(0, capacity)
                held = held.set_column(1, "w", pc.subtract(held.column("w"), less))
                held = held.filter(pc.greater(held.column("w"), 0))
        kept = [] if held is None else held.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([None, *[r["k"] for r in kept]], pa.string()), pa.array([off, *[r["w"] for r in kept]], pa.int64())], ["key", "weight"])

    rows = df.where((F.col(cents) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(cents).alias("w"))
    return rows.mapInArrow(task, "key string, weight long")


def top_keys(df: DataFrame, key: str, cents: str, n: int, capacity: int = CAPACITY) -> tuple[list[str], int]:
    """Candidates for the ``n`` largest sums of ``cents``, and the most that
    the sum of any other key can be."""
    found = summaries(df, key, cents, capacity)
    merged = found.groupBy("key").agg(F.sum("weight").alias("weight"))
    # one more than there are candidates, to know the largest that is left out; and the row of what was taken off
    best = merged.orderBy(F.col("key").isNull().desc(), F.desc("weight"), "key").limit(capacity + 2).collect()
    off = sum(r["weight"] for r in best if r["key"] is None)
    rest = [r for r in best if r["key"] is not None]
    return [r["key"] for r in rest[:capacity]], off + (rest[capacity]["weight"] if len(rest) > capacity else 0)


def top_sums(df: DataFrame, key: str, cents: str, n: int, report: Callable[[DataFrame], DataFrame], sums: str, capacity: int = CAPACITY) -> DataFrame:
    """``report(df)``, the first ``n`` rows by the column ``sums`` (in units,
    descending) of a report with a row for each ``key``, from the candidates'
    rows alone if that is certain."""
    keys, most = top_keys(df, key, cents, n, capacity)
    if len(keys) >= n and keys:
        table = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` string")  # at most ``capacity`` keys
        first = materialize(report(df.join(F.broadcast(table), key, "left_semi")))
        smallest = first.agg(F.min(sums)).first()[0]
        if certain(smallest, most):
            return first
    return report(df)


def certain(smallest: float | None, most: int) -> bool:
    """Does the smallest of the first sums exceed ``most`` cents?"""
    return smallest is not None and round(smallest * 100) > most

