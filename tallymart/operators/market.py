"""Price pools and what is read from them: references, positions, boxes, bands, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions.times import elapsed_days
from tallymart.operators import pools
from tallymart.operators.listings import is_healthy
from tallymart.params import ALL_TIERS, DEFAULTS, SOLD, Params


def is_active(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin(*SOLD)


def pool_members(listings: DataFrame) -> DataFrame:
    """Healthy listings with a variant and a price: those that make a market."""
    return listings.filter(F.col("variant_key").isNotNull() & ~F.col("variant_key").isin("", "auto") & (F.col("price") > 0) & is_healthy(F.col("tier")))


def variant_pools(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The pool of each variant inside the fences, of variants that keep enough; see ``pools``."""
    return pools.fenced(pools.pool_of(pool_members(listings), ["variant_key"]), ["variant_key"], params.pool_min)


def pool_stats(variants: DataFrame) -> DataFrame:
    """Mean, extremes, median and size of each pool."""
    stats = (pools.mean().alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), pools.median().alias("median_price"))
    return pools.per_pool(variants, ["variant_key"], *stats)


def market_snapshot(listings: DataFrame, key: str, day: Column) -> DataFrame:
    """``(key, trend_date, avg_price, min_price, max_price, volume)`` after the fences, one row a key and day."""
    keys = [key, "trend_date"]
    kept = pools.fenced(pools.pool_of(listings.withColumn("trend_date", day), keys), keys)
    return pools.per_pool(kept, keys, pools.mean().alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")).withColumnRenamed("n", "volume")


def sold_references(listings: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(variant_key, tier, median_price, n)`` of sold listings, by tier and over all tiers."""
    sold = listings.filter(F.col("status").isin(*SOLD) & F.col("variant_key").isNotNull())
    each = sold.withColumn("tier", F.explode(F.array(F.coalesce("tier", F.lit("buono")), F.lit(ALL_TIERS))))
    keys = ["variant_key", "tier"]
    return pools.per_pool(pools.fenced(pools.pool_of(each, keys), keys, params.sold_min), keys, pools.median().alias("median_price"))


def price_positions(listings: DataFrame, variants: DataFrame) -> DataFrame:
    """``listings`` with the share of the variant's pool strictly below the price; null without a pool.

    A listing meets one running count, however large its variant is.
    """
    order = Window.partitionBy("variant_key").orderBy("price")
    marks = listings.select("variant_key", "price", F.lit(0).cast("long").alias("same")).distinct().unionByName(variants.select("variant_key", "price", F.col("n").alias("same")))
    running = marks.groupBy("variant_key", "price").agg(F.sum("same").alias("same")).withColumn("under", F.sum("same").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("same"))
    sizes = variants.groupBy("variant_key").agg(F.max("size").alias("pool_n"))
    shares = running.join(sizes, "variant_key").select("variant_key", "price", (F.col("under") / F.col("pool_n")).alias("position"))
    return listings.join(shares, ["variant_key", "price"], "left")


def km_models(listings: DataFrame, key: str, x: str, y: str, params: Params = DEFAULTS, latest: int | None = None) -> DataFrame:
    """Least squares of price on kilometres per key, over all its rows or so many ``latest`` ones; falling lines only."""
    usable = listings.filter((F.col(x) > 0) & (F.col(y) > 0))
    if latest is not None:
        order = Window.partitionBy(key).orderBy(F.desc("found_at"), "id")
        usable = usable.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= latest)
    fitted = usable.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))
    return fitted.filter((F.col("n") >= params.km_min) & (F.col("slope") < 0))


def resale_suggestions(listings: DataFrame, key: str = "model", params: Params = DEFAULTS) -> DataFrame:
    """``(key, fast_price, full_price, n)``: lower quartile and median of healthy active prices."""
    active = listings.filter(is_active(F.col("status")) & is_healthy(F.col("tier")))
    enough = pools.pool_of(active, [key], params.box_min)
    return pools.per_pool(enough, [key], pools.quantile(1, 4).alias("fast_price"), pools.quantile(2, 4).alias("full_price"))


def model_boxes(listings: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Per model: volume, week's inflow, sellers, five numbers, lowest tenth, spread, and how many ask under 0.85 of the median."""
    active = listings.filter(is_active(F.col("status")) & (F.col("price") > 0))
    new = F.col("found_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    volumes = active.groupBy("model").agg(F.count("*").alias("volume"), F.count_if(new).alias("inflow"), F.count_distinct("seller_id").alias("sellers"))
    healthy = pools.pool_of(active.filter(is_healthy(F.col("tier"))), ["model"], params.box_min).withColumn("cheap", F.col("price") < 0.85 * pools.median(pools.over_keys(["model"])))
    boxes = pools.per_pool(
        healthy, ["model"], F.min("price").alias("low"), pools.quantile(1, 4).alias("q1"), pools.median().alias("mid"), pools.quantile(3, 4).alias("q3"), F.max("price").alias("high"), pools.quantile(1, 10).alias("p10"),
        F.sum(F.when(F.col("cheap"), F.col("n")).otherwise(0)).alias("under_market"),
    ).drop("n")
    return volumes.join(boxes, "model", "left").withColumn("spread", F.col("mid") - F.col("p10")).withColumn("margin_potential", S.percent(F.col("spread"), F.col("mid")))


def group_medians(listings: DataFrame, keys: list[str], healthy: bool, params: Params = DEFAULTS) -> DataFrame:
    """Median and count of active prices per keys, of groups with enough."""
    active = listings.filter(is_active(F.col("status")) & (F.col("price") > 0))
    if healthy:
        active = active.filter(is_healthy(F.col("tier")))
    return active.groupBy(*keys).agg(F.median("price").alias("median_price"), F.count("*").alias("n")).filter(F.col("n") >= params.pool_min)


def facets(listings: DataFrame, dims: list[str]) -> DataFrame:
    """``(facet, value, n)``: counts by each of the dimensions, in one pass of grouping sets."""
    active = listings.filter(is_active(F.col("status"))).select(*dims)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("facet"), F.col(d).cast("string").alias("value")) for d in dims]))
    return active.select(each.alias("f")).filter(F.col("f.value").isNotNull()).groupBy(F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def sold_facts(listings: DataFrame) -> DataFrame:
    """Sold listings with ``days``, those from 0 to 365 only."""
    sold = listings.filter(F.col("status").isin(*SOLD)).withColumn("days", elapsed_days(F.col("found_at"), F.col("sold_at")))
    return sold.filter(F.col("days").between(0, 365))


def sold_stats(listings: DataFrame, as_of: Column, key: str = "model", params: Params = DEFAULTS) -> DataFrame:
    """Per model: mean days to sell, sales, median and highest price, and sales of the last week."""
    facts = sold_facts(listings)
    week = F.col("sold_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    out = facts.groupBy(key).agg((F.sum(F.col("days").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("avg_days"), F.count("*").alias("sold"), F.median("price").alias("median_price"), F.max("price").alias("max_price"), F.count_if(week).alias("outflow"))
    return out.filter(F.col("sold") >= params.sold_stats_min)


def price_bands(listings: DataFrame, key: str = "model", params: Params = DEFAULTS) -> DataFrame:
    """Thirds of a model's sales by price, then id, cut at n // 3 and 2n // 3: extremes, mean days and count of each.

    Prices are counted before they are ranked, so a hot model brings its
    distinct prices to a task; only the sales of the at most two prices that a
    cut divides are ranked by id.
    """
    facts = sold_facts(listings).select(F.col(key).alias("k"), "price", "id", F.col("days").cast("decimal(18,6)").alias("days"))
    rank = pools.ranked(facts.groupBy("k", "price").agg(F.count("*").alias("n"), F.sum("days").alias("days")), ["k"], params.bands_min)

    def third(nth: Column) -> Column:
        return F.when(nth <= F.floor(F.col("size") / 3), 1).when(nth <= F.floor(F.col("size") * 2 / 3), 2).otherwise(3)

    ends = rank.withColumns({"band": third(F.col("upto") - F.col("n") + 1), "last": third(F.col("upto"))})
    whole = ends.filter("band = last").select("k", "band", "price", "n", "days")
    cut = ends.filter("band != last").select(F.col("k").alias("cut_k"), F.col("price").alias("cut_price"), (F.col("upto") - F.col("n")).alias("before"), "size")
    met = facts.join(cut, F.col("k").eqNullSafe(F.col("cut_k")) & F.col("price").eqNullSafe(F.col("cut_price")))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("k", "price").orderBy("id"))
    divided = met.withColumn("band", third(nth)).select("k", "band", "price", F.lit(1).cast("long").alias("n"), "days")
    both = whole.unionByName(divided).groupBy(F.col("k").alias(key), "band")
    return both.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), (F.sum("days").cast("double") / F.sum("n")).alias("avg_days"), F.sum("n").alias("n"))


def time_to_sale_cube(listings: DataFrame, dims: list[str]) -> DataFrame:
    """Mean days, count and median price for every subset of the dimensions; fewer than 3 sales are thin."""
    out = sold_facts(listings).cube(*dims).agg((F.sum(F.col("days").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("avg_days"), F.count("*").alias("n"), F.median("price").alias("median_price"), F.grouping_id().cast("long").alias("level"))
    return out.withColumn("thin", F.col("n") < 3)


def weighted_mean_days(groups: DataFrame) -> DataFrame:
    return groups.agg((F.sum(F.col("avg_days") * F.col("n")) / F.sum("n")).alias("avg_days"), F.sum("n").alias("n"))


def liquidity(volumes: DataFrame, sold: DataFrame, key: str = "model") -> DataFrame:
    """Per model: sell-through, demand, the index and its level, from ``volumes`` (volume, inflow) and ``sold`` (sold, avg_days, outflow)."""
    both = volumes.select(key, "volume", "inflow").join(sold.select(key, "sold", "avg_days", "outflow"), key, "full_outer")
    both = both.withColumns({"volume": F.coalesce("volume", F.lit(0)), "sold": F.coalesce("sold", F.lit(0))})
    through = S.percent(F.col("sold"), F.col("sold") + F.col("volume"))
    demand = F.when(F.col("inflow") > 0, F.col("outflow") / F.col("inflow"))
    parts = F.array_compact(F.array(F.least(through, F.lit(100.0)), F.least(F.greatest((30 - F.col("avg_days")) / 27 * 100, F.lit(0.0)), F.lit(100.0)), F.least(demand * 50, F.lit(100.0))))
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts))
    index = F.when(F.col("volume") < 3, mean * 0.6).otherwise(mean)
    out = both.withColumns({"sell_through": through, "demand": demand}).withColumn("liquidity", index)
    return out.withColumn("level", F.when(F.col("liquidity") >= 66, "alta").when(F.col("liquidity") >= 33, "media").when(F.col("liquidity").isNotNull(), "bassa"))


def trend_changes(snapshots: DataFrame, key: str) -> DataFrame:
    """First and last mean of each series and the change in percent; two snapshots at least."""
    at = F.struct("trend_date", "avg_price")
    series = snapshots.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= 2)
    return series.select(key, F.col("first.avg_price").alias("first_avg"), F.col("last.avg_price").alias("last_avg"), "n", S.percent(F.col("last.avg_price") - F.col("first.avg_price"), F.col("first.avg_price")).alias("change_pct"))


def latest_averages(snapshots: DataFrame, key: str) -> DataFrame:
    """The newest mean that is not null."""
    return snapshots.filter(F.col("avg_price").isNotNull()).groupBy(key).agg(F.max_by("avg_price", F.struct("trend_date", "avg_price")).alias("market_avg"))


def model_overview(volumes: DataFrame, sold: DataFrame, trends: DataFrame, key: str = "model") -> DataFrame:
    """All models that are listed, sold or followed, ranked by return, then price potential, then volume; 0 ranks as none."""
    out = volumes.join(sold, key, "full_outer").join(trends.select(key, "change_pct"), key, "full_outer")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0)))
