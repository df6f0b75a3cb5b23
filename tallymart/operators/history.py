"""Price changes, sellers, runs and deals over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions.times import elapsed_days, whole_days
from tallymart.params import DEFAULTS, SOLD, Params


def latest_change(history: DataFrame) -> DataFrame:
    """The newest change of each listing; ties by the new and the old price."""
    newest = F.max(F.struct("changed_at", "new_price", "old_price")).alias("c")
    return history.groupBy("listing_id").agg(newest).select("listing_id", "c.old_price", "c.new_price", "c.changed_at")


def changes_by_listing(history: DataFrame) -> DataFrame:
    """First and last change of each listing, ``f`` and ``l``, ties by the new and the old price, and how many were drops."""
    at = F.struct("changed_at", "new_price", "old_price")
    return history.groupBy("listing_id").agg(F.min(at).alias("f"), F.max(at).alias("l"), F.count_if(F.col("new_price") < F.col("old_price")).alias("drops"))


def watched(changed: DataFrame, as_of: Column) -> DataFrame:
    """``changed`` (see ``changes_by_listing``) with first old and last new price, total fall and its level, which is null where the price has not fallen."""
    out = changed.withColumns({"first_price": F.col("f.old_price"), "last_price": F.col("l.new_price"), "days_since": whole_days(F.col("l.changed_at"), as_of)})
    out = out.withColumn("drop_eur", F.col("first_price") - F.col("last_price")).withColumn("drop_pct", S.percent(F.col("drop_eur"), F.col("first_price")))
    level = F.when((F.col("drops") >= 2) | (F.col("drop_pct") >= 10), "alto").otherwise("medio")
    return out.withColumn("level", F.when((F.col("drops") > 0) & (F.col("drop_eur") > 0), level))


def price_watch(history: DataFrame, as_of: Column) -> DataFrame:
    """First old and last new price, drops, total fall and its level, of listings whose price has fallen."""
    out = watched(changes_by_listing(history), as_of).filter(F.col("level").isNotNull())
    return out.select("listing_id", "first_price", "last_price", "drops", "days_since", "drop_eur", "drop_pct", "level")


def seller_profiles(listings: DataFrame, drops: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per seller: active, sold, listed, listings with a drop, mean valid days to sell, drop rate, and whether motivated.

    ``drops`` has one row ``(id)`` for each listing whose price fell.
    """
    was_sold = F.col("status").isin(*SOLD)
    elapsed = elapsed_days(F.col("found_at"), F.col("sold_at"))
    judged = listings.select("id", "seller_id", was_sold.alias("was_sold"), F.when(was_sold & elapsed.between(0, 365), elapsed).cast("decimal(18,6)").alias("valid"))
    marked, sold, valid = judged.join(drops.select("id", F.lit(1).alias("dropped")), "id", "left"), F.col("was_sold"), F.col("valid")
    out = marked.groupBy("seller_id").agg(
        F.count_if(~sold).alias("active"), F.count_if(sold).alias("sold"), F.count("*").alias("listed"), F.count("dropped").alias("dropped"),
        (F.sum(valid).cast("double") / F.when(F.count(valid) > 0, F.count(valid))).alias("avg_days"),
    )
    out = out.withColumn("drop_rate", S.percent(F.col("dropped"), F.col("listed")))
    return out.withColumn("motivated", F.coalesce(F.col("avg_days") <= params.motivated_days, F.lit(False)) | F.coalesce(F.col("drop_rate") >= params.motivated_drop_rate, F.lit(False)))


def rank_sellers(profiles: DataFrame, n: int = 25) -> DataFrame:
    """The n first sellers by motivation, then by listings, of those with two at least."""
    size = F.col("active") + F.col("sold")
    return profiles.filter(size >= 2).orderBy(F.desc("motivated"), size.desc(), "seller_id").limit(n)


def needs_reclassifying(active: DataFrame, batch: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Sellers that stop being private: more than so many listings, stored and new together."""
    both = active.select("seller_id").unionAll(batch.select("seller_id")).filter(F.col("seller_id").isNotNull())
    return both.groupBy("seller_id").agg(F.count("*").alias("listings")).filter(F.col("listings") > params.reclassify_above)


def run_status(targets: Column, ok: Column, failed: Column, scraped: Column) -> Column:
    return F.when(targets == 0, "idle").when((ok == 0) | (scraped == 0), "down").when(failed > 0, "degraded").otherwise("ok")


def health_transitions(runs: DataFrame) -> DataFrame:
    """Runs whose category has just gone down or recovered.

    Runs are ordered inside their hour; the first of an hour follows the last
    of the hour with runs before it, so a category is in one task with a row
    for each of its hours and not with all of its runs.
    """
    at = F.struct("ran_at", "id")
    hourly = runs.withColumn("__hour", F.date_trunc("hour", "ran_at"))
    last = hourly.groupBy("category", "__hour").agg(F.max(F.struct("ran_at", "id", "status")).alias("last"))
    carried = last.select(F.col("category").alias("__c"), F.col("__hour").alias("__h"), F.lag("last.status").over(Window.partitionBy("category").orderBy("__hour")).alias("__carried"))
    inside = Window.partitionBy("category", "__hour").orderBy(at)
    out = hourly.withColumns({"__nth": F.row_number().over(inside), "before": F.lag("status").over(inside)})
    out = out.join(carried, F.col("category").eqNullSafe(F.col("__c")) & F.col("__hour").eqNullSafe(F.col("__h")))
    out = out.withColumn("before", F.when(F.col("__nth") == 1, F.col("__carried")).otherwise(F.col("before"))).select(*runs.columns, "before")
    down, was = F.col("status") == "down", F.coalesce(F.col("before") == "down", F.lit(False))
    return out.withColumn("transition", F.when(down & ~was, "went_down").when(~down & was, "recovered")).filter(F.col("transition").isNotNull())


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("ran_at"), F.desc("id")))).filter(F.col("nth") <= n)


def deal_results(deals: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Deals with invested money, profit, margin, error of the estimate, days held, and staleness.

    Money that is 0 counts as missing where it divides; a listing with several
    deals keeps them all.
    """
    extra = F.aggregate("extra_costs", F.lit(0.0), lambda a, c: a + F.coalesce(c["amount"], F.lit(0.0)))
    out = deals.withColumn("invested", F.col("buy_price") + extra)
    sold = F.col("stage") == "venduto"
    out = out.withColumn("profit", F.when(sold & (F.col("invested") != 0), F.col("sell_price") - F.col("invested")))
    held = whole_days(F.col("created_at"), F.col("updated_at"))
    out = out.withColumns({"margin_pct": S.percent(F.col("profit"), F.col("invested")), "estimate_error": F.col("profit") - (F.col("market_avg") - F.col("invested")), "held_days": F.when(sold, held)})
    out = out.withColumn("roi_per_day", F.when(F.col("held_days") > 0, F.col("margin_pct") / F.col("held_days")))
    limit = S.by_key(F.col("stage"), {k: float(v) for k, v in params.stage_limits.items()}).cast("int")
    waited = whole_days(F.col("updated_at"), as_of)
    stale = F.when(waited >= 2 * limit, "critico").when(waited >= limit, "fermo")
    loss = F.when(F.col("stage").isin(*params.owned_stages), F.col("carry_month") * waited / 30)
    return out.withColumns({"stage_days": waited, "staleness": stale, "accrued_loss": loss})


def deals_summary(results: DataFrame) -> DataFrame:
    """One row of key figures over all deals."""
    sold, open_ = F.col("stage") == "venduto", F.col("stage").isin("acquistato", "in_vendita")
    dec = lambda c: F.sum(F.when(c[0], F.col(c[1]).cast("decimal(28,4)"))).cast("double")
    error = F.abs(F.col("estimate_error")) / F.abs(F.col("market_avg") - F.col("invested"))
    out = results.agg(
        F.count("*").alias("deals"), F.count_if(sold).alias("sold"), F.count_if(open_).alias("open"), dec((sold, "profit")).alias("realised"), dec((open_, "invested")).alias("open_invested"),
        F.count_if(F.col("staleness").isNotNull()).alias("stale"), F.count_if(F.col("staleness") == "critico").alias("critical"), F.sum(F.col("accrued_loss").cast("decimal(28,4)")).cast("double").alias("accrued_loss"),
        (F.sum(F.when(sold, F.col("estimate_error")).cast("decimal(28,4)")).cast("double") / F.count(F.when(sold, F.col("estimate_error")))).alias("bias"),
        F.avg(F.when(sold & (F.col("market_avg") != F.col("invested")), error)).alias("mean_error"),
    )
    return out.withColumn("accuracy", F.greatest(F.lit(0.0), 100 - F.col("mean_error") * 100)).drop("mean_error")


def depreciation(prices: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Median by line and generation, newest first: loss against the next newer one and what is retained of the newest.

    ``prices`` has ``(line, number, price)``; generation n came out in
    September of 2008 + n.
    """
    medians = prices.groupBy("line", "number").agg(F.median("price").alias("median_price"), F.count("*").alias("n")).filter(F.col("n") >= params.pool_min)
    newest = Window.partitionBy("line").orderBy(F.desc("number"))
    out = medians.withColumn("released", F.make_date(F.lit(2008) + F.col("number"), F.lit(9), F.lit(1)))
    out = out.withColumns({"older_number": F.lead("number").over(newest), "older_price": F.lead("median_price").over(newest), "newest_price": F.first("median_price").over(newest), "generations": F.count("*").over(Window.partitionBy("line"))})
    gap = F.col("number") - F.col("older_number")
    fits = F.col("older_number").isNotNull() & (gap <= 3)
    loss = F.when(fits, (F.col("median_price") - F.col("older_price")) / gap)
    out = out.filter(F.col("generations") > 1).withColumn("loss_year", loss)
    out = out.withColumns({"loss_pct": S.percent(F.col("loss_year"), F.col("median_price")), "loss_month": F.col("loss_year") / 12, "retention_pct": S.percent(F.col("median_price"), F.col("newest_price")), "age_years": F.datediff(as_of, F.col("released")) / 365.25})
    return out.select("line", "number", "median_price", "n", "loss_year", "loss_pct", "loss_month", "retention_pct", "age_years")
