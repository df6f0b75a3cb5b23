"""From a raw listing to its signals, its variant and its condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import text as T
from tallymart.params import CAR, DEFAULTS, HEALTHY, Params

# Defects that make a phone or a car broken.
BROKEN_PHONE = ("schermo-rotto", "icloud-bloccato", "per-ricambi", "da-riparare", "face-id-rotto", "back-rotto")
BROKEN_CAR = ("incidentata", "fuso")
PHONE_NAME = r"(?i)iphone\s*(\d{2})\s*(pro\s*max|pro|plus|mini|air|e)?\b"


def parse_listings(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """``df`` with km, year, storage_gb, battery_pct, color, features, defects_noted, urgency_flags, exclude_from_iqr and is_accessory."""
    raw = F.concat_ws(" ", F.nullif(F.col(title), F.lit("")), F.nullif(F.col(description), F.lit("")))
    out = df.withColumns({"__raw": raw, "__text": T.folded(raw)})
    text = F.col("__text")
    out = out.withColumns({
        "km": T.kilometres(F.col("__raw")), "year": T.year(F.col("__raw")), "storage_gb": T.storage_gb(F.col("__raw")), "battery_pct": T.battery_pct(F.col("__raw")),
        "color": T.first_tag(text, T.COLORS), "features": F.concat(T.tags(text, T.CAR_FEATURES), T.tags(text, T.PHONE_FEATURES)),
        "defects_noted": F.concat(T.tags(text, T.CAR_DEFECTS), T.tags(text, T.PHONE_DEFECTS)), "urgency_flags": T.tags(text, T.URGENCY), "is_accessory": T.sells_accessory(F.col(title)),
    })
    renewed = F.array_contains("features", "Batteria-Cambiata")
    out = out.withColumn("defects_noted", F.when(renewed, F.array_remove("defects_noted", "batteria-esausta")).otherwise(F.col("defects_noted")))
    return out.withColumn("exclude_from_iqr", F.arrays_overlap("defects_noted", F.array(*map(F.lit, T.NOT_MARKET)))).drop("__raw", "__text")


def condition_tier(category: Column, defects: Column, features: Column) -> Column:
    has = lambda names: F.arrays_overlap(defects, F.array(*map(F.lit, names)))
    car = F.when(has(BROKEN_CAR), "incidentata").when(F.size(defects) > 0, "difetti").otherwise("buono")
    phone = F.when(has(BROKEN_PHONE), "rotto").when(F.size(defects) > 0, "difetti").when(F.array_contains(features, "Pari-al-Nuovo"), "come-nuovo").otherwise("buono")
    return F.when(category == CAR, car).otherwise(phone)


def is_healthy(tier: Column) -> Column:
    return F.coalesce(tier, F.lit("buono")).isin(*HEALTHY)


def variant_key(category: Column, title: Column, storage: Column, query: Column, min_year: Column, max_year: Column) -> Column:
    """A phone's line, number and storage; a car's query and years; else the query or title and the storage."""
    number, suffix = F.regexp_extract(title, PHONE_NAME, 1), F.regexp_replace(F.lower(F.regexp_extract(title, PHONE_NAME, 2)), r"\s", "")
    ending = F.when(suffix == "promax", "-pro-max").when(suffix == "e", "e").when(suffix == "", "").otherwise(F.concat(F.lit("-"), suffix))
    phone = F.concat(F.lit("iphone-"), number, ending, F.lit("-"), F.coalesce(F.nullif(storage, F.lit(0)).cast("string"), F.lit("na")))
    years = F.when(min_year.isNotNull() | max_year.isNotNull(), F.concat(F.lit("-"), F.coalesce(min_year.cast("string"), F.lit("")), F.lit("-"), F.coalesce(max_year.cast("string"), F.lit("")))).otherwise("")
    car = F.btrim(F.regexp_replace(F.concat(T.slug(F.coalesce(query, F.lit("auto"))), years), "--", "-"), F.lit("-"))
    named = T.slug(F.coalesce(F.nullif(query, F.lit("")), F.nullif(title, F.lit("")), F.lit("altro")))
    other = F.concat_ws("-", named, F.nullif(storage, F.lit(0)).cast("string"))
    return F.when(category == CAR, car).when(F.coalesce(number, F.lit("")) != "", phone).otherwise(other)


def model_key(variant: Column) -> Column:
    """The variant without its last part; null for none and for cars without a query."""
    return F.when((variant != "") & (variant != "auto"), F.regexp_replace(variant, "-[^-]*$", ""))


def price_in_bounds(category: Column, price: Column, params: Params = DEFAULTS) -> Column:
    low, high = params.car_price_bounds
    return F.coalesce(F.when(category == CAR, price.between(low, high)).otherwise(price >= params.phone_price_floor), F.lit(False))


def meets_filters(min_year: Column, max_year: Column, max_km: Column, transmission: Column, year: Column, km: Column, gear: Column) -> Column:
    """A target's wishes; an attribute that is missing fails a wish."""
    def wish(asked: Column, met: Column) -> Column:
        return asked.isNull() | F.coalesce(met, F.lit(False))

    return wish(min_year, year >= min_year) & wish(max_year, year <= max_year) & wish(max_km, km <= max_km) & wish(transmission, F.lower(gear) == F.lower(transmission))


def first_failing(min_year: Column, max_year: Column, max_km: Column, transmission: Column, year: Column, km: Column, gear: Column) -> Column:
    none = F.lit(None).cast("int")
    text = F.lit(None).cast("string")
    return (
        F.when(~meets_filters(min_year, max_year, none, text, year, km, gear), "anno")
        .when(~meets_filters(none, none, max_km, text, year, km, gear), "km")
        .when(~meets_filters(none, none, none, transmission, year, km, gear), "cambio")
    )


def meets_phone_filters(storage_wish: Column, battery_wish: Column, storage: Column, battery: Column) -> Column:
    """The storage must be known and equal; a battery that is unknown passes."""
    return (storage_wish.isNull() | F.coalesce(storage == storage_wish, F.lit(False))) & (battery_wish.isNull() | F.coalesce(battery >= battery_wish, F.lit(True)))
