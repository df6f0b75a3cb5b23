"""Deals with the listings they came from and what it costs to hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators import history
from tallymart.params import CAR, DEFAULTS, Params

LISTED, SUMMED = 200, 1000


def with_carry(deals: DataFrame, listings: DataFrame, carry: DataFrame) -> DataFrame:
    """``deals`` (id, listing_id, category, ...) with their listing's ``variant_key`` and ``carry_month``.

    Every deal stays, however many share a listing, and each gets the cost of
    its own variant. Cars, and deals that were put in by hand without a
    listing, have none. ``listings`` has one row an id, ``carry`` one a variant.
    """
    variants = listings.select(F.col("id").alias("listing_id"), "variant_key")
    held = deals.drop("variant_key", "carry_month").join(variants, "listing_id", "left").join(carry.select("variant_key", "carry_month"), "variant_key", "left")
    return held.withColumn("carry_month", F.when(F.col("category") != CAR, F.col("carry_month")))


def deal_list(deals: DataFrame, listings: DataFrame, carry: DataFrame, as_of: Column, stages: tuple[str, ...] = (), n: int = LISTED, params: Params = DEFAULTS) -> DataFrame:
    """The ``n`` deals changed last, of the given stages or all, with results and staleness; ties by id."""
    wanted = deals.filter(F.col("stage").isin(*stages)) if stages else deals
    latest = wanted.orderBy(F.desc("updated_at"), "id").limit(n)
    return history.deal_results(with_carry(latest, listings, carry), as_of, params).orderBy(F.desc("updated_at"), "id")


def summary(deals: DataFrame, listings: DataFrame, carry: DataFrame, as_of: Column, n: int = SUMMED, params: Params = DEFAULTS) -> DataFrame:
    """Key figures over the ``n`` deals changed last."""
    return history.deals_summary(deal_list(deals, listings, carry, as_of, (), n, params))


def in_pipeline(listings: DataFrame, deals: DataFrame) -> DataFrame:
    """``listings`` with ``in_pipeline``: whether a deal came from them."""
    taken = deals.filter(F.col("listing_id").isNotNull()).select(F.col("listing_id").alias("id")).distinct().withColumn("in_pipeline", F.lit(True))
    return listings.join(taken, "id", "left").withColumn("in_pipeline", F.coalesce("in_pipeline", F.lit(False)))
