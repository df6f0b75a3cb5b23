"""The listings feed: filters on stored and derived columns, presets, sorting and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators.market import is_active


@dataclass(frozen=True)
class Wanted:
    """What a reader asks for; None asks for nothing."""

    category: str | None = None
    storage_gb: int | None = None
    color: str | None = None
    tier: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    model: str | None = None
    deal_classes: tuple[str, ...] | None = None
    min_margin: float | None = None
    min_days: int | None = None
    max_days: int | None = None
    text: str | None = None
    triage: str | None = None
    preset: str | None = None


def _conditions(w: Wanted) -> list[Column]:
    col, found = F.col, []
    for name, value in (("category", w.category), ("storage_gb", w.storage_gb), ("color", w.color), ("tier", w.tier), ("model", w.model)):
        found += [col(name) == value] if value is not None else []
    for name, low, high in (("price", w.min_price, w.max_price), ("margin_pct", w.min_margin, None), ("days_online", w.min_days, w.max_days)):
        found += [col(name) >= low] if low is not None else []
        found += [col(name) <= high] if high is not None else []
    if w.deal_classes is not None:
        found.append(col("deal_class").isin(*w.deal_classes) if w.deal_classes else F.lit(False))
    if w.text and w.text.strip():
        found.append(F.contains(F.lower("title"), F.lit(w.text.strip().lower())) | F.contains(F.lower("location"), F.lit(w.text.strip().lower())))
    if w.triage == "salvati":
        found.append(col("triage").eqNullSafe("salvato"))
    elif w.triage == "attivi":
        found.append(~col("triage").eqNullSafe("scartato"))
    presets = {"compra_ora": lambda: col("buy_at_asking") & (col("deal_class") != "sospetto"), "motivati": lambda: col("seller_motivated"), "riparabili": lambda: col("repair_margin_pct") > 0}
    if w.preset:
        found.append(presets[w.preset]())
    return found


def filtered(listings: DataFrame, wanted: Wanted) -> DataFrame:
    """Active listings that meet all wishes; a null meets none."""
    out = listings.filter(is_active(F.col("status")))
    for condition in _conditions(wanted):
        out = out.filter(F.coalesce(condition, F.lit(False)))
    return out


#: What a feed is sorted by, and what a null counts as.
SORTS = {"score": lambda: F.coalesce("score", F.lit(0)).desc(), "margin": lambda: F.col("market_margin_pct").desc_nulls_last(), "roi": lambda: F.col("roi_per_day").desc_nulls_last(), "recent": lambda: F.col("found_at").desc_nulls_last()}


def page(listings: DataFrame, by: str, offset: int = 0, size: int = 50, key: str = "id") -> DataFrame:
    """A page in one of SORTS or in descending order of the column ``by``, nulls last; equal ones by id."""
    order = SORTS[by]() if by in SORTS else F.col(by).desc_nulls_last()
    return listings.orderBy(order, F.col(key)).offset(offset).limit(size)


def ordered_facets(facets: DataFrame) -> DataFrame:
    """Facets by name; their values by count, the most first, but amounts of storage from the smallest."""
    amount = F.when(F.col("facet") == "storage_gb", F.col("value").try_cast("long"))
    return facets.orderBy("facet", amount.asc_nulls_last(), F.desc("n"), "value")
