"""Fair value, deal class, negotiation limits, deal score and risk of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions import text as T
from tallymart.functions.times import elapsed_days
from tallymart.operators import pools
from tallymart.params import CAR, DEFAULTS, Params

REPAIRABLE = ("schermo-rotto", "batteria-esausta")
UNSELLABLE = ("per-ricambi", "da-riparare")
KIT = ("Scatola", "Fattura", "Garanzia-Apple")


def condition_factor(category: Column, tier: Column, params: Params = DEFAULTS) -> Column:
    return F.when(category == CAR, S.by_key(tier, params.car_factors, 1.0)).otherwise(S.by_key(tier, params.phone_factors, 1.0))


def fair_value(category: Column, tier: Column, pool_median: Column, sold_tier: Column, sold_any: Column, km_estimate: Column, params: Params = DEFAULTS) -> Column:
    """Pool median, replaced by a sold reference, for cars by a positive kilometre estimate; times the condition unless the reference is of the tier."""
    base = F.coalesce(F.when((category == CAR) & (km_estimate > 0), km_estimate), sold_tier, sold_any, pool_median)
    of_tier = sold_tier.isNotNull() & ~F.coalesce((category == CAR) & (km_estimate > 0), F.lit(False))
    return F.when(of_tier, base).otherwise(base * condition_factor(category, tier, params))


def deal_class(asking: Column, fair: Column, has_photo: Column, params: Params = DEFAULTS) -> Column:
    ratio = asking / F.when(fair > 0, fair)
    margin = S.percent(fair - asking, asking)
    return (
        F.when(asking.isNull() | (asking <= 0) | fair.isNull() | (fair <= 0), "n/d")
        .when(ratio < params.suspect_ratio, "sospetto")
        .when((margin >= params.deal_pct) & (ratio < params.no_photo_ratio) & ~has_photo, "sospetto")
        .when(margin >= params.deal_pct, "affare")
        .when(ratio > params.expensive_ratio, "caro")
        .otherwise("in-linea")
    )


def value_listings(listings: DataFrame, variants: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All listings with fair value, margin (of the asking price) and class against the median of their variant's pool; ``n/d`` without one."""
    medians = pools.per_pool(variants, ["variant_key"], pools.median().alias("pool_median")).drop("n")
    out = listings.join(medians, "variant_key", "left")
    none = F.lit(None).cast("double")
    out = out.withColumn("fair_value", fair_value(F.col("category"), F.col("tier"), F.col("pool_median"), none, none, none, params))
    return out.withColumns({"margin_eur": F.col("fair_value") - F.col("price"), "margin_pct": S.percent(F.col("fair_value") - F.col("price"), F.col("price")), "deal_class": deal_class(F.col("price"), F.col("fair_value"), F.lit(True), params)})


def confidence(samples: Column) -> Column:
    return F.when(samples >= 15, "alta").when(samples >= 6, "media").otherwise("bassa")


def model_tier(title: Column) -> Column:
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.when(text.contains("pro max"), "pro-max").when(text.contains("plus"), "plus").when(text.contains("pro"), "pro").otherwise("base")


def repair_cost(category: Column, title: Column, defects: Column, params: Params = DEFAULTS) -> Column:
    """Prices of the standard parts that a phone's defects need, by its line."""
    total = F.lit(0)
    for defect in REPAIRABLE:
        prices = S.by_key(model_tier(title), {line: float(parts[defect]) for line, parts in params.part_prices.items()}).cast("int")
        total = total + F.when(F.array_contains(defects, defect), prices).otherwise(0)
    return F.when(category == CAR, F.lit(0)).otherwise(total)


def defect_penalty(category: Column, defects: Column, params: Params = DEFAULTS) -> Column:
    each = F.transform(defects, lambda d: S.by_key(d, {k: float(v) for k, v in params.car_penalties.items()}, 0.0).cast("int"))
    return F.when(category == CAR, F.aggregate(each, F.lit(0), lambda a, v: a + v)).otherwise(0)


def _step(category: Column, params: Params) -> Column:
    return S.by_key(category, {k: float(v) for k, v in params.rounding_step.items()}, float(params.other_step))


def _kept_share(category: Column, params: Params) -> Column:
    return 1 - S.by_key(category, params.target_margin_pct, params.other_margin_pct) / 100


def suggested_offer(category: Column, market: Column, asking: Column, penalty: Column, repair: Column, params: Params = DEFAULTS) -> Column:
    """The opening offer: what leaves the target margin, under the asking price, in whole steps; null if none is left."""
    raw = F.least(market * _kept_share(category, params) - penalty - repair, F.when(asking > 0, asking * params.opening_share))
    return F.when((market > 0) & (raw > 0), S.floor_to(raw, _step(category, params)))


def max_bid(category: Column, resale: Column, penalty: Column, repair: Column, carry: Column, params: Params = DEFAULTS) -> Column:
    raw = resale * _kept_share(category, params) - penalty - repair - carry
    return F.when((resale > 0) & (raw > 0), S.floor_to(raw, _step(category, params)))


def freshness_points(found_at: Column, as_of: Column) -> Column:
    hours = elapsed_days(found_at, as_of) * 24
    return F.when(hours <= 2, 12).when(hours <= 24, 8).when(hours <= 72, 4).otherwise(0)


def deal_score(category: Column, margin_pct: Column, freshness: Column, seller_type: Column, n_defects: Column, n_urgency: Column, n_kit: Column, battery: Column, dropped: Column) -> Column:
    """0 to 100: margin up to 55 points at 33 percent, and what makes a listing fresh, negotiable and whole."""
    points = F.when(margin_pct > 0, F.least(margin_pct, F.lit(33.0)) / 33 * 55).otherwise(0.0) + freshness
    points = points + F.when(n_urgency > 0, 8).otherwise(0) + F.when(seller_type == "privato", 8).when(seller_type == "finto_privato", 2).otherwise(0) + F.when(dropped, 8).otherwise(0)
    points = points - F.least(4 * n_defects, F.lit(12)) + F.least(2 * n_kit, F.lit(4))
    cell = F.when(battery >= 90, 3).when(battery < 85, -3).otherwise(0)
    points = points + F.when(category != CAR, F.coalesce(cell, F.lit(0))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(points, 0).cast("int")))


def risk_score(defects: Column, description: Column, deal: Column, ai_scam_high: Column, seller_type: Column, seller_sold: Column) -> Column:
    """Sum of the signals' weights, 100 at most; null without any."""
    has = lambda names: F.arrays_overlap(defects, F.array(*map(F.lit, names)))
    each = [
        (has(("icloud-bloccato",)), 45), (description.rlike(T.SCAM), 30), ((deal == "sospetto") | ai_scam_high, 25), (has(UNSELLABLE), 12), (seller_type == "finto_privato", 10), (seller_sold == 0, 6),
    ]
    total = F.lit(0)
    for signal, weight in each:
        total = total + F.when(signal, weight).otherwise(0)
    return F.when(total > 0, F.least(total, F.lit(100)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 45, "alto").when(score >= 20, "medio").when(score > 0, "basso")


def ai_override(deal: Column, score: Column, legit: Column, scam_high: Column) -> tuple[Column, Column]:
    """Class and score after the analysis of a description: it clears a suspect or makes one."""
    suspect = deal == "sospetto"
    cleared = suspect & legit & ~scam_high
    return F.when(cleared, "affare").when(suspect | scam_high, "sospetto").otherwise(deal), F.when(~cleared & (suspect | scam_high), 0).otherwise(score)


def roi_per_day(margin_pct: Column, days: Column) -> Column:
    return F.when(days > 0, margin_pct / days)


def margin_calculator(buy: Column, sell: Column, fee_pct: Column, shipping: Column) -> tuple[Column, Column]:
    """Net profit and its share of the selling price after fees and shipping."""
    profit = sell - buy - sell * fee_pct / 100 - shipping
    return profit, S.percent(profit, sell)
