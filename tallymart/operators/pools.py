"""Price pools as histograms: how many listings ask each price, never a list of all of them.

A pool is a relation with a row for each of its prices: the keys, ``price``,
``n`` (listings that ask it), ``upto`` (those that ask it or less) and ``size``
(all of the pool). Counts are made before the shuffle, so a key with a third of
all listings brings its distinct prices to a task and not its rows, and the
running sums spill where they do not fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Pick = Callable[[Column], Column]


def ranked(counted: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """``counted`` (keys, price, n) with ``upto`` and ``size``, of pools with ``least`` listings or more."""
    key = Window.partitionBy(*keys)
    running = key.orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumns({"upto": F.sum("n").over(running), "size": F.sum("n").over(key)}).filter(F.col("size") >= least)


def pool_of(listings: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """The pool of positive prices per keys."""
    return ranked(listings.filter(F.col("price") > 0).groupBy(*keys, "price").agg(F.count("*").alias("n")), keys, least)


def _price_at(rank: Column) -> Column:
    """The price that the ``rank``-th listing of a pool asks, from the cheapest; an aggregate."""
    return F.max(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("price")))


def over_keys(keys: Sequence[str]) -> Pick:
    """Picks a price for every row of a pool, instead of one for each group."""
    return lambda rank: _price_at(rank).over(Window.partitionBy(*keys))


def quantile(i: int, parts: int, pick: Pick = _price_at) -> Column:
    """The i-th of parts-1 cut points of a pool by the exclusive method, inter- or extrapolated; null under two listings."""
    size = F.col("size")
    at = F.greatest(F.lit(1), F.least(size - 1, F.floor(F.lit(i) * (size + 1) / parts)))
    over = F.lit(i) * (size + 1) - at * parts
    return F.when(size >= 2, (pick(at) * (parts - over) + pick(at + 1) * over) / parts)


def median(pick: Pick = _price_at) -> Column:
    """The middle price of a pool, the mean of the two middle ones of an even number."""
    size = F.col("size")
    low, high = pick(F.floor((size + 1) / 2)), pick(F.floor(size / 2) + 1)
    return F.when(size % 2 == 1, low).otherwise((low + high) / 2)


def fenced(pool: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """The pool inside 1.5 quartile distances; unchanged with fewer than 4 listings or no spread."""
    every = over_keys(keys)
    cut = pool.withColumns({"q1": quantile(1, 4, every), "q3": quantile(3, 4, every)})
    spread = F.col("q3") - F.col("q1")
    inside = F.col("price").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    kept = cut.filter((F.col("size") < 4) | (spread <= 0) | inside)
    return ranked(kept.select(*keys, "price", "n"), keys, least)


def mean() -> Column:
    """The mean price of a pool; summed as decimals, so that it does not depend on the order of rows."""
    return F.sum(F.col("price").cast("decimal(18,2)") * F.col("n").cast("decimal(18,0)")).cast("double") / F.col("size")


def per_pool(pool: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    """One row for each pool: keys, ``columns`` and the size as ``n``."""
    return pool.groupBy(*keys, "size").agg(*columns).withColumnRenamed("size", "n")
