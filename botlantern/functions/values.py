"""Arithmetic that is safe for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole_: Column) -> Column:
    """part / whole, 0.0 where the whole is 0 or missing."""
    return F.when(whole_ != 0, F.coalesce(part, F.lit(0)).cast("double") / whole_.cast("double")).otherwise(F.lit(0.0))


def whole(value: Column) -> Column:
    """A whole number; missing or unreadable: 0."""
    return F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))
