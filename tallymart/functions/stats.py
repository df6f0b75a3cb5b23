"""Robust statistics as column functions over sorted arrays, and exact means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(value: Column) -> Column:
    """Mean of money: summed as decimals, so that it does not depend on the order of rows."""
    return F.sum(value.cast("decimal(18,2)")).cast("double") / F.when(F.count(value) > 0, F.count(value))


def quantile(ordered: Column, i: int, n: int) -> Column:
    """The i-th of n-1 cut points of a sorted array by the exclusive method; null under two values.

    Cut i lies at i * (size + 1) / n, kept between the first and the last but
    one value, and is inter- or extrapolated from there.
    """
    size = F.size(ordered)
    at = F.greatest(F.lit(1), F.least(size - 1, F.floor(F.lit(i) * (size + 1) / n).cast("int")))
    over = F.lit(i) * (size + 1) - at * n
    return F.when(size >= 2, (F.try_element_at(ordered, at) * (n - over) + F.try_element_at(ordered, at + 1) * over) / n)


def median(ordered: Column) -> Column:
    """Middle of a sorted array, mean of the two middle ones; null if empty."""
    size = F.size(ordered)
    low = F.try_element_at(ordered, F.greatest(F.lit(1), ((size + 1) / 2).cast("int")))
    high = F.try_element_at(ordered, (size / 2).cast("int") + 1)
    return F.when(size % 2 == 1, low).when(size > 0, (low + high) / 2)


def floor_to(value: Column, step: Column | int) -> Column:
    return value - F.pmod(value, F.lit(step) if isinstance(step, int) else step)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0 or null."""
    return F.when(whole != 0, part / whole * 100)


def by_key(key: Column, table: dict[str, float], otherwise: float | None = None) -> Column:
    """Value of a small table of fixed values by key."""
    out = F.lit(otherwise) if otherwise is not None else F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out
