"""Market averages of all targets in one plan; a target whose input is bad does not touch the others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions.text import holds_all_words
from tallymart.operators import fleet, listings, pools
from tallymart.operators.incremental import first_of, upserted
from tallymart.params import DEFAULTS, PHONE, Params
from tallymart.sources.ads import PAGE, ads_of_page_rows
from tallymart.staging import stage

WISHES = "min_year int, max_year int, max_km int, transmission string, storage_gb int, min_battery int"
PER_TARGET = 50
#: Pages of a target whose ads are looked at before those of targets that are not full then.
PAGES_AHEAD = 10


@dataclass(frozen=True)
class Night:
    """``results`` has a row a target, ``snapshots`` those of good targets with prices, ``quarantine`` the inputs that made a target fail."""

    results: DataFrame
    snapshots: DataFrame
    quarantine: DataFrame
    new_products: DataFrame


def _wishes(targets: DataFrame) -> DataFrame:
    """``targets`` with their filters parsed as ``wish``, and ``bad_filters``, the text where that fails."""
    parsed = F.from_json("strict_filters", f"{WISHES}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = targets.withColumn("__parsed", parsed)
    return out.withColumns({"wish": F.col("__parsed").dropFields("__bad"), "bad_filters": F.col("__parsed.__bad"), "wishes": F.coalesce(F.trim("strict_filters"), F.lit("")).isin("", "{}", "null") == F.lit(False)}).drop("__parsed")


def _taken(pages: DataFrame, most: int, params: Params) -> DataFrame:
    """The ``most`` first ads of each target that are taken, with ``nth``."""
    ads = pages.select("target_id", "category", "query", "wish", "wishes", "start", F.posexplode("ads").alias("place", "ad"))
    found = ads_of_page_rows(ads, "target_id", "category", "query", "wish", "wishes", "start", "place")
    likely = found.filter(listings.price_in_bounds(F.col("category"), F.col("price"), params) & (F.col("wishes") | holds_all_words(F.col("title"), F.col("query"))))
    parsed = listings.parse_listings(likely)  # only what the filter asks of it is worked out for all that the cheap tests leave
    year, km, w = F.coalesce("ad_year", "year"), F.coalesce("ad_km", "km"), F.col("wish")
    phone = F.col("category") == PHONE
    fits = listings.meets_filters(w["min_year"], w["max_year"], w["max_km"], w["transmission"], year, km, F.col("transmission")) & (~phone | listings.meets_phone_filters(w["storage_gb"], w["min_battery"], F.col("storage_gb"), F.col("battery_pct")))
    kept = parsed.filter((~F.col("wishes") | fits) & ~(phone & F.col("is_accessory"))).select(*likely.columns)
    once = first_of(kept, ["target_id", "listing_url"], [F.col("start"), F.col("place")])
    nth = F.row_number().over(Window.partitionBy("target_id").orderBy("start", "place"))
    first = once.withColumn("nth", nth).filter(F.col("nth") <= most)
    return listings.parse_listings(first).select("target_id", "price", "exclude_from_iqr", "nth")  # defects matter for these alone


def run_night(targets: DataFrame, pages: DataFrame, products: DataFrame, day: Column, params: Params = DEFAULTS, most: int = PER_TARGET) -> Night:
    """The averages of ``day`` for every active target, from ``pages`` (target_id, start, page; the page as JSON text).

    A target takes its ``most`` first ads, by page and place, that are in
    bounds, fit its wishes (or, without wishes, hold all words of its query),
    sell no accessory and have a new url. Listings that the text rules out of a
    market count as scraped but not in the average.

    Ads of later pages are looked at only for targets that the first
    ``PAGES_AHEAD`` pages do not fill; what is taken is the same.

    Filters or a page that are no JSON make their target fail: it gets a row
    with ``error``, no average, and its input in the quarantine. A target
    without pages has none scraped. Targets' ids are unique.
    """
    fleet_now = _wishes(fleet.active_fleet(targets)).select(F.col("id").alias("target_id"), "category", "query", "strict_filters", "wish", "wishes", "bad_filters")
    raw = pages.join(fleet_now.select("target_id", "category", "query", "wish", "wishes"), "target_id")
    opened = raw.withColumn("__page", F.from_json("page", f"{PAGE}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    no_page = F.col("__page.__bad").isNotNull() | F.col("__page").isNull()
    # a stored table, as pages are read for what is bad and again for their ads
    opened = stage(opened.select("target_id", "start", "category", "query", "wish", "wishes", no_page.alias("no_page"), F.when(no_page, F.col("page")).alias("page"), F.when(~no_page, F.col("__page.ads")).alias("ads")), "opened")
    quarantine = fleet_now.filter(F.col("bad_filters").isNotNull()).select("target_id", F.lit("filters").alias("input"), F.lit(None).cast("int").alias("start"), F.col("bad_filters").alias("text"))
    quarantine = quarantine.unionByName(opened.filter("no_page").select("target_id", F.lit("page").alias("input"), F.col("start").cast("int").alias("start"), F.col("page").alias("text")))
    failed = quarantine.groupBy("target_id").agg(F.min("input").alias("error"))

    good_pages = opened.filter("NOT no_page").join(failed, "target_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("target_id").orderBy("start"))
    reach = good_pages.select("target_id", "start").withColumn("turn", turn).filter(F.col("turn") <= PAGES_AHEAD).groupBy("target_id").agg(F.max("start").alias("reach"))
    ahead = good_pages.join(reach, "target_id").filter(F.coalesce(F.col("start") <= F.col("reach"), F.lit(True))).drop("reach")
    early = stage(_taken(ahead, most, params), "early")
    full = early.groupBy("target_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("target_id")
    late = _taken(good_pages.join(full, "target_id", "left_anti"), most, params)
    taken = stage(early.join(full, "target_id", "left_semi").unionByName(late), "taken")

    counts = taken.groupBy("target_id").agg(F.count("*").alias("scraped"), F.count_if(~F.col("exclude_from_iqr")).alias("considered"), F.count_if("exclude_from_iqr").alias("excluded"))
    inside = pools.fenced(pools.pool_of(taken.filter(~F.col("exclude_from_iqr")), ["target_id"]), ["target_id"])
    stats = pools.per_pool(inside, ["target_id"], F.round(pools.mean(), 2).alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")).withColumnRenamed("n", "volume")
    new, product_of = fleet.products_for(products, fleet_now.join(failed, "target_id", "left_anti").select(F.col("query").alias("model"), "category"))
    named = fleet_now.select("target_id", "category", "query").join(failed, "target_id", "left").join(counts, "target_id", "left").join(stats, "target_id", "left")
    named = named.join(product_of.select(F.col("model").alias("query"), "category", "product_id"), ["query", "category"], "left")
    good = F.col("error").isNull()
    zero = {c: F.when(good, F.coalesce(c, F.lit(0))) for c in ("scraped", "considered", "excluded")}
    results = named.withColumns(zero).select("target_id", "category", "query", "product_id", "scraped", "considered", "excluded", "avg_price", "min_price", "max_price", "volume", "error")
    snapshots = results.filter(good & F.col("volume").isNotNull()).select("target_id", "product_id", day.alias("trend_date"), "avg_price", "min_price", "max_price", "volume")
    return Night(results, snapshots, quarantine, new)


def with_night(stored: DataFrame, night: Night) -> DataFrame:
    """Stored averages with those of the night in the place of the same target and day; targets that failed keep theirs."""
    return upserted(stored, night.snapshots, ["target_id", "trend_date"], [F.col("avg_price")])
