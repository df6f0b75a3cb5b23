"""What readers see: labels, tiers, the listing view under its names, and values as JSON has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, StructType, TimestampNTZType, TimestampType

from tallymart.functions.text import title_of_url
from tallymart.functions.times import whole_days

# Names of the listing view by our columns, in its order, and bounds of the tiers.
VIEW = {
    "id": "id", "title": "title", "location": "location", "price": "askingPrice", "original_price": "originalPrice", "market_avg": "marketAvg", "market_margin_eur": "marginEur", "market_margin_pct": "marginPct", "price_drop": "priceDrop", "description": "description",
    "image_urls": "images", "found_at": "foundAt", "days_online": "daysOnline", "source": "source", "status": "status", "triage": "triage", "listing_url": "url", "seller_type": "sellerType", "defects_noted": "defects", "urgency_flags": "urgencyFlags", "features": "features",
    "year": "year", "km": "km", "transmission": "transmission", "fuel": "fuel", "storage_gb": "storageGb", "battery_pct": "batteryPct", "variant_key": "variantKey", "tier": "conditionTier", "color": "color", "analysis": "ai",
}
LISTS = ("image_urls", "defects_noted", "urgency_flags", "features")
HIGH_MARGIN, HIGH_SCORE, FAIR_SCORE = 20, 70, 45


def model_label(key: Column) -> Column:
    """``iphone-13-pro-max`` as ``iPhone 13 Pro Max``; parts that begin with a digit stay, other makes are capitalised."""
    parts = F.split(key, "-")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda p: F.when(p.rlike(r"^\d"), p).otherwise(F.initcap(p)))
    return F.when(F.get(parts, F.lit(0)) == "iphone", F.trim(F.concat(F.lit("iPhone "), F.array_join(rest, " ")))).otherwise(F.initcap(F.replace(key, F.lit("-"), F.lit(" "))))


def margin_tier(percent: Column) -> Column:
    return F.when(percent.isNull(), "n/d").when(percent >= HIGH_MARGIN, "Alto margine").when(percent < 0, "Sotto media").otherwise("Margine medio")


def score_tier(score: Column) -> Column:
    """``high``, ``fair`` or ``low``."""
    return F.when(score >= HIGH_SCORE, "high").when(score >= FAIR_SCORE, "fair").when(score.isNotNull(), "low")


def relative_time(at: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days ago, rounded down; times to come are now, none is a dash."""
    seconds = F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000), F.lit(0))
    ago = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    return F.when(at.isNull(), "—").when(seconds < 60, "just now").when(seconds < 3600, ago(60, " min ago")).when(seconds < 86400, ago(3600, "h ago")).otherwise(ago(86400, "d ago"))


def listing_view(listings: DataFrame, as_of: Column, model: Column | None = None, source: str = "Subito") -> DataFrame:
    """The listing view under its names; columns that a market lacks are null, lists are never.

    A listing without a title is called by its url, else by its model.
    """
    have = set(listings.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None)
    special = {
        "title": F.coalesce(F.nullif(value("title").cast("string"), F.lit("")), title_of_url(value("listing_url").cast("string")), F.lit(None).cast("string") if model is None else model),
        "source": F.lit(source), "days_online": whole_days(F.col("found_at"), as_of),
    }
    picked = [special.get(c, F.coalesce(value(c).cast("array<string>"), F.array().cast("array<string>")) if c in LISTS else value(c)).alias(name) for c, name in VIEW.items()]
    return listings.select(*picked)


def _as_json(value: Column, kind: DataType) -> Column:
    if isinstance(kind, DecimalType):
        return value.cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.when(F.date_format(value, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(value, "SSSSSS")))
        return F.concat(whole, micros, F.lit("+00:00" if isinstance(kind, TimestampType) else ""))
    if isinstance(kind, DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _as_json(v, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_as_json(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_values(df: DataFrame) -> DataFrame:
    """``df`` at its boundary: times and dates as ISO texts (in UTC, with microseconds where there are any), decimals as doubles, also inside lists and structs."""
    return df.select(*[_as_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def headline(models: DataFrame) -> DataFrame:
    """One row over ranked models (rank, model, median_price, opportunity, change_pct): the mean of their medians, the first one if it has an opportunity, and the first with a trend.

    The mean is in whole euros, over models with a median that is not 0.
    """
    price = F.when(F.col("median_price") != 0, F.col("median_price"))
    mean = F.bround(F.sum(price.cast("decimal(28,4)")).cast("double") / F.count(price)).cast("long")
    first = F.min_by(F.when(F.coalesce("opportunity", F.lit(0.0)) != 0, F.col("model")), "rank")
    trend = F.min_by("model", F.when(F.col("change_pct").isNotNull(), F.col("rank")))
    return models.agg(mean.alias("avg_market_price"), first.alias("top_opportunity"), trend.alias("trend_model"), F.count("*").alias("models"))


def ranked_models(models: DataFrame) -> DataFrame:
    """``models`` (roi_per_day, opportunity, volume, model) with ``rank``: by return, opportunity and volume, where 0 counts as none; ties by name.

    A row a model: their number does not grow with listings, so one task ranks them.
    """
    from pyspark.sql import Window

    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1.0))
    order = [none("roi_per_day").desc(), none("opportunity").desc(), F.coalesce("volume", F.lit(0)).desc(), F.col("model")]
    return models.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
