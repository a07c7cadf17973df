"""Report parameters.

The reference reads "today" in three places; here every date is an explicit
parameter so results are reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class ReportParams:
    """``as_of`` (the reporting day) and ``week_start`` (the Monday of the plan
    week) have no default.  Filters that are None keep every row."""

    as_of: dt.date
    week_start: dt.date
    weekly_goal: float = 1_400_000.0
    include_overdue: bool = True
    # the trained model, or the rules where it cannot be trained
    score_mode: str = "auto"
    # report filters (P6) and limit filters
    filter_start: dt.date | None = None
    filter_end: dt.date | None = None
    filter_statuses: tuple[str, ...] | None = None
    limit_segments: tuple[str, ...] | None = None
    limit_low: float | None = None
    limit_high: float | None = None

    @property
    def week_end(self) -> dt.date:
        return self.week_start + dt.timedelta(days=6)
