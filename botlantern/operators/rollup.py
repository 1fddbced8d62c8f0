"""The daily rollup of AI requests, rebuilt for the dates that new records touched.

`rebuilt` is the plan: one job over all dirty dates. `Rollup` keeps it on stored tables: records and the
markers of their dates are one commit; markers go only after their dates are rebuilt from records that
were there when the markers were, so a crash at any point is mended by the next run, and dates that
another writer marks meanwhile stay marked. Repeating a batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ai import model_daily, normalised


def dirty_dates(*marked: DataFrame) -> DataFrame:
    """Distinct dates of several sets of markers or records."""
    whole = marked[0].select("date")
    for m in marked[1:]:
        whole = whole.unionByName(m.select("date"))
    return whole.distinct()


def rebuilt(old: DataFrame, requests: DataFrame, dates: DataFrame) -> DataFrame:
    """The rollup with the given dates made anew; rows of theirs that no request has are gone."""
    kept = old.join(dates.select("date"), "date", "left_anti")
    return kept.unionByName(model_daily(requests.join(dates.select("date"), "date", "left_semi")).select(*old.columns))


@dataclass
class RecomputeSummary:
    dates: list[int] = field(default_factory=list)
    rows_written: int = 0
    failed_dates: list[int] = field(default_factory=list)
    pending_after: list[int] = field(default_factory=list)
    pending_state_unknown: bool = False


class Rollup:
    def __init__(self, tables):
        self.tables = tables

    def record(self, requests: DataFrame) -> list[int]:
        """Write raw records and mark their dates."""
        return self.tables.commit(lambda change: self.add(change, requests))

    @staticmethod
    def add(change, requests: DataFrame) -> list[int]:
        """Raw records and the marks of their dates as part of a commit."""
        dates = change.upsert("ai_request", normalised(requests))
        change.mark(dates)
        return dates

    def mark(self, dates: list[int]) -> None:
        self.tables.commit(lambda change: change.mark(dates))

    def pending(self) -> list[int]:
        return sorted(int(d) for d in self.tables.state().dirty)

    def has_pending_dates(self) -> bool:
        return bool(self.pending())

    def clear(self, dates: list[int], at: int | None = None) -> None:
        """Unmark dates, but those that were marked after a commit."""
        if dates:
            self.tables.commit(lambda change: change.clear(dates, at))

    def rebuild(self, dates: list[int]) -> int:
        """Make the rollup of dates anew, in one job; once more if another writer has rebuilt one of them meanwhile."""

        def work(change) -> int:
            requests = change.read("ai_request").where(F.col("date").isin(dates))
            rows = model_daily(requests).persist()
            try:
                return change.replace("ai_model_daily", rows, dates)
            finally:
                rows.unpersist()

        return self.tables.commit(work)

    def recompute(self) -> RecomputeSummary:
        """Rebuild all dirty dates; if that fails, each by itself, so that one bad date stops no other."""
        summary = RecomputeSummary()
        try:
            state = self.tables.state()
            at, todo = state.version, sorted(int(d) for d in state.dirty)
        except Exception:
            summary.pending_state_unknown = True
            return summary
        done: list[int] = []
        try:
            if todo:
                summary.rows_written = self.rebuild(todo)
            done = todo
        except Exception:
            for date in todo:
                try:
                    summary.rows_written += self.rebuild([date])
                    done.append(date)
                except Exception:
                    summary.failed_dates.append(date)
        summary.dates = done
        try:
            self.clear(done, at)
            summary.pending_after = self.pending()
        except Exception:
            # Dates that could not be cleared count as pending.
            summary.pending_after, summary.pending_state_unknown = todo, True
        return summary
