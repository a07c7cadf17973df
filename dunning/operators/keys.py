"""Joining rows with facts about their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a fact table up to which every task may hold it.
SMALL = 100_000


def join_on(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """``left`` joined with ``right`` on ``by``, where null equals null; the
    keys come once."""
    names = {c: f"_right_{i}" for i, c in enumerate(by)}
    right = right.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return left.join(F.broadcast(right) if broadcast else right, on, how).drop(*names.values())


def join_small(rows: DataFrame, facts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """:func:`join_on` with ``facts`` whose keys are distinct.  Facts of up to
    ``SMALL`` groups, counted first, go to every task, and no row moves; more
    are joined by shuffle, where Spark splits what is skewed."""
    return join_on(rows, facts, by, how, broadcast=facts.limit(SMALL + 1).count() <= SMALL)
