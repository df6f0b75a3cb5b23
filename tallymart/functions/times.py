"""Elapsed time; ``as_of`` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def elapsed_days(start: Column, end: Column) -> Column:
    """Days from start to end, with fractions."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(_DAY)


def whole_days(start: Column, end: Column) -> Column:
    """Whole days elapsed, not below 0."""
    return F.greatest(F.floor(elapsed_days(start, end)), F.lit(0)).cast("long")


def parsed(text: Column) -> Column:
    """ISO timestamps, null where they are none."""
    return F.try_to_timestamp(text)
