"""Day numbers (days since 1970-01-01 in the session's time zone), hours and windows of days.

Two windows are in use and stay apart: messages, commands and user ranks look at the closed past
[today - days, today); active users, AI and image figures at the open range from today - days on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def instant_of_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def day_of_ms(ms: Column) -> Column:
    return day_number(instant_of_ms(ms))


def hour_of_ms(ms: Column) -> Column:
    return F.hour(instant_of_ms(ms))


def day_label(day: Column) -> Column:
    """An ISO date of a day number."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def closed_past(day: Column, as_of: int, days: int) -> Column:
    return (day >= as_of - days) & (day < as_of)


def open_ended(day: Column, as_of: int, days: int) -> Column:
    return day >= as_of - days


def yesterday(ts: Column, as_of: int) -> Column:
    """Instants of the day before `as_of`; a range that a scan can push down."""
    day = F.date_from_unix_date(F.lit(as_of))
    return (ts >= F.date_sub(day, 1)) & (ts < day)
