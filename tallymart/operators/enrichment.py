"""A listing with all that is known about its market, its seller and its price.

Every side is one row a key, aggregated before the join, and every join is a
left one, so no listing is lost: what is unknown stays null and the class is
``n/d``. Sides by seller and listing come first, while rows are narrow; those
by variant, model and target are written, and which are broadcast is left to
their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions.times import whole_days
from tallymart.operators import history, market, pools, valuation
from tallymart.params import ALL_TIERS, CAR, DEFAULTS, Params
from tallymart.staging import stage

#: Columns a market may lack, and their types.
OPTIONAL = {
    "target_id": "string", "title": "string", "description": "string", "km": "int", "original_price": "double", "seller_type": "string", "battery_pct": "int", "defects_noted": "array<string>", "urgency_flags": "array<string>",
    "features": "array<string>", "has_photo": "boolean", "ai_legit": "boolean", "ai_scam_high": "boolean", "sold_at": "timestamp",
}


def with_optional(listings: DataFrame) -> DataFrame:
    """``listings`` with nulls in the columns it lacks."""
    return listings.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in listings.columns})


def _join(rows: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    return rows.join(side, list(keys), "left")


def _side(rows: DataFrame, side: DataFrame, *keys: str) -> DataFrame:
    """Joins a side that is small in most markets, written first: the size that the planner guesses grows with the market, and all rows would be shuffled for it."""
    return _join(rows, stage(side, "side"), *keys)


def market_average(rows: DataFrame, by_target: DataFrame | None, by_model: DataFrame | None) -> DataFrame:
    """``market_avg``: the pool's mean, else the target's latest average, else the model's."""
    found: list[Column] = [F.col("pool_mean")]
    for side, key, name in ((by_target, "target_id", "__target_avg"), (by_model, "model", "__model_avg")):
        if side is not None:
            rows = _side(rows, side.select(key, F.col("market_avg").alias(name)), key)
            found.append(F.col(name))
    return rows.withColumn("market_avg", F.coalesce(*found)).drop("__target_avg", "__model_avg")


def with_references(rows: DataFrame, every: DataFrame, as_of: Column, params: Params) -> DataFrame:
    """Pool statistics, sold references of the tier and of all tiers, the kilometre line of the target, and days to sell of the model."""
    stats = pools.per_pool(market.variant_pools(every, params), ["variant_key"], pools.mean().alias("pool_mean"), pools.median().alias("pool_median")).withColumnRenamed("n", "pool_n")
    sold = market.sold_references(every, params)
    of_tier = sold.filter(F.col("tier") != ALL_TIERS).select("variant_key", "tier", F.col("median_price").alias("sold_tier"), F.col("n").alias("sold_tier_n"))
    of_all = sold.filter(F.col("tier") == ALL_TIERS).select("variant_key", F.col("median_price").alias("sold_any"), F.col("n").alias("sold_any_n"))
    lines = market.km_models(every.filter((F.col("category") == CAR) & market.is_active(F.col("status"))), "km_key", "km", "price", params).select("km_key", "slope", "intercept")
    days = market.sold_stats(every, as_of, params=params).select("model", F.col("avg_days").alias("sold_days"))
    rows = rows.withColumn("tier", F.coalesce("tier", F.lit("buono")))
    for side, keys in ((stats, ["variant_key"]), (of_tier, ["variant_key", "tier"]), (of_all, ["variant_key"]), (lines, ["km_key"]), (days, ["model"])):
        rows = _side(rows, side, *keys)
    return rows


def valued(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Fair value and its source, margins, class, and how many samples it stands on."""
    expected = F.when(F.col("category") == CAR, F.col("intercept") + F.col("slope") * F.when(F.col("km") != 0, F.col("km")))
    rows = rows.withColumn("km_estimate", expected)
    rows = rows.withColumns({
        "expected_price": F.when(F.col("km_estimate") > 0, F.col("km_estimate")), "sold_reference": F.coalesce("sold_tier", "sold_any"),
        "sold_n": F.coalesce("sold_tier_n", "sold_any_n", F.lit(0)), "fair_value": valuation.fair_value(F.col("category"), F.col("tier"), F.col("pool_median"), F.col("sold_tier"), F.col("sold_any"), F.col("km_estimate"), params),
    })
    fair, price = F.col("fair_value"), F.when(F.col("price") > 0, F.col("price"))
    samples = F.coalesce("pool_n", F.lit(0)) + F.col("sold_n")
    return rows.withColumns({
        "margin_vs_expected": F.col("expected_price") - price,
        "fair_source": F.when(fair.isNull(), F.lit(None)).when(F.col("km_estimate").isNotNull(), "km").when(F.col("sold_reference") > 0, "venduti").otherwise("listati"),
        "margin_eur": fair - price, "margin_pct": S.percent(fair - price, price), "market_margin_eur": F.col("market_avg") - F.col("price"), "market_margin_pct": S.percent(F.col("market_avg") - price, price),
        "deal_class": valuation.deal_class(F.col("price"), fair, F.coalesce("has_photo", F.lit(True)), params), "samples": samples, "confidence": valuation.confidence(samples),
    })


def negotiated(rows: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Carry cost, repairs, offer and highest bid, the score, the class after the analysis of the description, and the risk."""
    empty = F.array().cast("array<string>")
    defects, urgency, features = (F.coalesce(c, empty) for c in ("defects_noted", "urgency_flags", "features"))
    category, price = F.col("category"), F.col("price")
    hold = F.when(F.col("sold_days") > 0, F.floor("sold_days")).otherwise(params.hold_days).cast("int")
    rows = rows.withColumns({
        "hold_days": hold, "days_estimated": ~F.coalesce(F.col("sold_days") > 0, F.lit(False)), "carry_total": F.when(F.col("carry_month") != 0, F.bround(F.col("carry_month") * hold / 30, 0).cast("int")),
        "repair_total": valuation.repair_cost(category, F.col("title"), defects, params), "penalty_total": valuation.defect_penalty(category, defects, params), "roi_per_day": valuation.roi_per_day(F.col("margin_pct"), F.col("sold_days")),
        "reference": F.coalesce(F.when(F.col("fair_value") != 0, F.col("fair_value")), F.col("market_avg")),
    })
    repair, penalty = F.col("repair_total"), F.col("penalty_total")
    resale = F.coalesce(F.when(F.col("sold_reference") > 0, F.col("sold_reference")), F.when(F.col("market_avg") > 0, F.col("market_avg")), F.col("reference"))
    net = F.when((repair > 0) & (price > 0), F.col("reference") - price - repair)
    rows = rows.withColumns({
        "repair_margin_eur": net, "repair_margin_pct": S.percent(net, price + repair), "suggested_offer": valuation.suggested_offer(category, F.col("reference"), price, penalty, repair, params),
        "max_bid": valuation.max_bid(category, resale, penalty, repair, F.coalesce("carry_total", F.lit(0)), params),
    })
    kit = F.size(F.array_intersect(features, F.array(*map(F.lit, valuation.KIT))))
    margin = F.coalesce("repair_margin_pct", "margin_pct", "market_margin_pct")
    score = valuation.deal_score(category, margin, valuation.freshness_points(F.col("found_at"), as_of), F.col("seller_type"), F.size(defects), F.size(urgency), kit, F.col("battery_pct"), F.col("price_drop").isNotNull())
    scam, legit = (F.coalesce(c, F.lit(False)) for c in ("ai_scam_high", "ai_legit"))
    rows = rows.withColumns({"buy_at_asking": F.coalesce(price <= F.col("max_bid"), F.lit(False)), "score": score})
    final, points = valuation.ai_override(F.col("deal_class"), F.col("score"), legit, scam)
    rows = rows.withColumns({"deal_class": final, "score": points})
    rows = rows.withColumn("risk", valuation.risk_score(defects, F.coalesce("description", F.lit("")), F.col("deal_class"), scam, F.col("seller_type"), F.col("seller_sold")))
    return rows.withColumn("risk_level", valuation.risk_level(F.col("risk"))).drop("reference")


def with_history(rows: DataFrame, every: DataFrame, changes: DataFrame | None, as_of: Column, params: Params) -> DataFrame:
    """The latest change of price or, without one, the fall from the first price; the watch on falls; and the seller's profile."""
    if changes is None:
        changes = every.sparkSession.createDataFrame([], "listing_id string, old_price double, new_price double, changed_at timestamp").withColumn("listing_id", F.col("listing_id").cast(every.schema["id"].dataType))
    watch = F.struct("first_price", "last_price", "drops", "drop_eur", "drop_pct", "days_since", "level")
    changed = history.watched(history.changes_by_listing(changes), as_of).select(
        F.col("listing_id").alias("id"), F.struct("l.old_price", "l.new_price", "l.changed_at").alias("last_change"), F.when(F.col("level").isNotNull(), watch).alias("price_watch")
    )
    fallen = changes.filter(F.col("new_price") < F.col("old_price")).select(F.col("listing_id").alias("id")).distinct()
    theirs = every if rows is every else every.join(rows.select("seller_id").distinct(), "seller_id", "left_semi")
    sellers = history.seller_profiles(theirs, fallen, params)
    sellers = sellers.select("seller_id", F.col("active").alias("seller_active"), F.col("sold").alias("seller_sold"), F.col("avg_days").alias("seller_days"), F.col("motivated").alias("seller_motivated"))
    for side, key in ((sellers, "seller_id"), (changed, "id")):
        rows = _join(rows, side, key)
    deduced = F.when(F.col("original_price") > F.col("price"), F.struct(F.col("original_price").alias("old_price"), F.col("price").cast("double").alias("new_price"), F.lit(None).cast("timestamp").alias("changed_at")))
    return rows.withColumn("price_drop", F.coalesce("last_change", deduced)).drop("last_change")


def carry_costs(depreciated: DataFrame, variant: Column) -> DataFrame:
    """``(variant_key, carry_month)``: what a variant loses a month, in whole euros; those that lose none are left out."""
    month = F.bround("loss_month", 0).cast("int")
    return depreciated.select(variant.alias("variant_key"), month.alias("carry_month")).filter(F.col("carry_month") != 0)


def enrich(
    listings: DataFrame, as_of: Column, rows: DataFrame | None = None, changes: DataFrame | None = None, by_target: DataFrame | None = None, by_model: DataFrame | None = None, carry: DataFrame | None = None, km_key: str = "target_id", params: Params = DEFAULTS
) -> DataFrame:
    """``rows`` (else all listings) of a market with references, value, history, seller, negotiation, score and risk.

    ``listings`` is the whole market, active and sold, that references come
    from. ``changes`` are price changes, ``by_target`` and ``by_model`` latest
    averages, ``carry`` costs a month (see ``carry_costs``). No row is lost or
    repeated, also those without variant, seller, price or model. Amounts and
    shares are not rounded; whole euros of carry and points of score are.
    """
    every = with_optional(listings)
    out = with_history(every if rows is None else with_optional(rows), every, changes, as_of, params)
    every, out = (some.withColumn("km_key", F.col(km_key)) for some in (every, out))
    out = with_references(out, every, as_of, params)
    out = market_average(out, by_target, by_model)
    out = out.withColumn("carry_month", F.lit(None).cast("int")) if carry is None else _side(out, carry.select("variant_key", "carry_month"), "variant_key")
    out = negotiated(valued(out, params), as_of, params).withColumn("days_online", whole_days(F.col("found_at"), as_of))
    return out.drop("km_key", "slope", "intercept", "km_estimate", "pool_mean", "pool_median", "sold_tier", "sold_tier_n", "sold_any", "sold_any_n")
