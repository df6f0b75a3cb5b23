"""One object over a market's tables, with a method for each thing a reader asks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators import deals as trade
from tallymart.operators import depreciation, enrichment, feed, fleet, history, labels, market
from tallymart.params import CAR, DEFAULTS, Params


def canonical(category: str) -> str:
    """``auto`` is another name of cars."""
    return CAR if category == "auto" else category


@dataclass(frozen=True)
class Engine:
    """``listings`` (id, seller_id, model, variant_key, category, price, status, tier, found_at, sold_at, ...), ``changes``, ``snapshots``, ``deals``, ``runs``, ``targets`` and the time of asking.

    ``carry`` (variant_key, carry_month) takes the place of what the curves of depreciation say.
    """

    listings: DataFrame
    as_of: Column
    changes: DataFrame | None = None
    snapshots: DataFrame | None = None
    deals: DataFrame | None = None
    runs: DataFrame | None = None
    params: Params = DEFAULTS
    carry: DataFrame | None = None
    targets: DataFrame | None = None

    def with_settings(self, **overrides: Any) -> Engine:
        return replace(self, params=self.params.overlaid(overrides))

    def _of(self, category: str | None) -> DataFrame:
        return self.listings.filter(F.col("category") == canonical(category)) if category else self.listings

    def valued(self, category: str | None = None) -> DataFrame:
        """Every listing with references, value, history, seller, negotiation, score and risk."""
        rows = self._of(category)
        averages = None if self.snapshots is None else market.latest_averages(self.snapshots, "model")
        valued = enrichment.enrich(rows, self.as_of, changes=self.changes, by_model=averages, carry=self.carry_costs(), km_key="target_id" if "target_id" in rows.columns else "model", params=self.params)
        if self.targets is not None and "target_id" in rows.columns:
            valued = fleet.with_target_names(valued, self.targets)
        return valued if self.deals is None or "listing_id" not in self.deals.columns else trade.in_pipeline(valued, self.deals)

    def feed_view(self, wanted: feed.Wanted = feed.Wanted(), by: str = "margin_pct", offset: int = 0, size: int = 50) -> DataFrame:
        """A page of the feed under the names that readers know, with JSON's values; a listing without a title is called by its url or target."""
        page = self.opportunities(wanted, by, offset, size)
        return labels.json_values(labels.listing_view(page, self.as_of, F.col("target_name") if "target_name" in page.columns else None))

    def opportunities(self, wanted: feed.Wanted = feed.Wanted(), by: str = "margin_pct", offset: int = 0, size: int = 50) -> DataFrame:
        return feed.page(feed.filtered(self.valued(wanted.category), wanted), by, offset, size)

    def total(self, wanted: feed.Wanted = feed.Wanted()) -> DataFrame:
        """How many listings the feed has for these wishes, beside its pages."""
        return feed.filtered(self.valued(wanted.category), wanted).agg(F.count("*").alias("total"))

    def facets(self, dims: tuple[str, ...] = ("model", "storage_gb", "color", "tier")) -> DataFrame:
        return feed.ordered_facets(market.facets(self.listings, list(dims)))

    def market_intelligence(self, category: str | None = None) -> DataFrame:
        rows = self._of(category)
        boxes = market.model_boxes(rows, self.as_of, self.params)
        liquid = market.liquidity(boxes, market.sold_stats(rows, self.as_of, params=self.params))
        return liquid.join(boxes.drop("volume", "inflow"), "model", "left").join(market.resale_suggestions(rows, params=self.params).drop("n"), "model", "left")

    def time_to_sale(self, dims: tuple[str, ...] = ("model", "color", "storage_gb"), category: str | None = None) -> DataFrame:
        return market.time_to_sale_cube(self._of(category), list(dims))

    def depreciation(self, category: str | None = None) -> DataFrame | None:
        """What phones lose with age, by line and storage, from active listings; None for cars, which have no generations."""
        if category and canonical(category) == CAR:
            return None
        active = self._of(category).filter(market.is_active(F.col("status")))
        return depreciation.points(market.variant_pools(active, self.params), F.to_date(self.as_of), self.params)

    def carry_costs(self) -> DataFrame:
        """What a month in stock costs, by variant: as given, else from the curves."""
        return depreciation.carry_costs(self.depreciation()) if self.carry is None else self.carry

    def sellers(self, drops: DataFrame, n: int = 25) -> DataFrame:
        return history.rank_sellers(history.seller_profiles(self.listings, drops, self.params), n)

    def price_watch(self) -> DataFrame:
        return history.price_watch(self.changes, self.as_of)

    def deal_results(self) -> DataFrame:
        """All deals with results and staleness; those with a ``listing_id`` at the cost of their listing's variant."""
        rows = self.deals
        if "listing_id" in rows.columns:
            rows = trade.with_carry(rows, self.listings, self.carry_costs())
        return history.deal_results(rows, self.as_of, self.params)

    def latest_deals(self, stages: tuple[str, ...] = (), n: int = trade.LISTED) -> DataFrame:
        return trade.deal_list(self.deals, self.listings, self.carry_costs(), self.as_of, stages, n, self.params)

    def deals_summary(self) -> DataFrame:
        return history.deals_summary(self.deal_results())

    def health(self) -> DataFrame:
        return history.health_transitions(self.runs)
