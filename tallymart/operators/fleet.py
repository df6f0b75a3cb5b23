"""Targets that are searched for, the products they stand for, and their names beside listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.params import CAR, PHONE

TARGET = "category string, query string, strict_filters string, is_active boolean"
# Phones by generation in their order, those outside the numbering with the generation they count as, and cars.
GENERATIONS = {
    11: ("", "Pro", "Pro Max"),
    12: ("mini", "", "Pro", "Pro Max"),
    13: ("mini", "", "Pro", "Pro Max"),
    14: ("", "Plus", "Pro", "Pro Max"),
    15: ("", "Plus", "Pro", "Pro Max"),
    16: ("", "Plus", "Pro", "Pro Max"),
    17: ("", "Air", "Pro", "Pro Max"),
}
SPECIALS = ((8, "iPhone 8"), (8, "iPhone 8 Plus"), (10, "iPhone X"), (10, "iPhone XR"), (10, "iPhone XS"), (10, "iPhone XS Max"), (16, "iPhone 16e"), (17, "iPhone 17e"), (11, "iPhone SE"))
CARS = ("BMW 123d", "BMW 125i")
FLEET_FROM = 13
PILOT = ((CAR, "Golf GTI", '{"min_year": 2017, "max_year": 2020, "max_km": 100000, "transmission": "automatic"}', True), (PHONE, "iPhone 14", "{}", True))


def specifications(spark: SparkSession) -> DataFrame:
    """``(place, generation, variants, query)``: a generation with its variants, or a special with its query."""
    rows = [(i, g, list(v), None) for i, (g, v) in enumerate(GENERATIONS.items())]
    rows += [(len(rows) + i, g, None, q) for i, (g, q) in enumerate(SPECIALS)]
    return spark.createDataFrame(rows, "place int, generation int, variants array<string>, query string")


def phone_targets(specs: DataFrame, from_generation: int = 0) -> DataFrame:
    """``(place, query)`` of the phones of a generation on, in the order of the specifications; of equal queries the first."""
    every = specs.filter(F.col("generation") >= from_generation).select("place", "generation", "query", F.posexplode(F.coalesce("variants", F.array(F.lit("")))).alias("nth", "variant"))
    named = F.coalesce("query", F.trim(F.concat_ws(" ", F.lit("iPhone"), F.col("generation").cast("string"), F.col("variant"))))
    return every.groupBy(named.alias("query")).agg(F.min(F.struct("place", "nth")).alias("at")).select("query", F.col("at.place").alias("place"), F.col("at.nth").alias("nth"))


def _targets(queries: DataFrame, category: str) -> DataFrame:
    return queries.select(F.lit(category).alias("category"), "query", F.lit("{}").alias("strict_filters"), F.lit(True).alias("is_active"))


def wanted_fleet(spark: SparkSession, from_generation: int = FLEET_FROM, cars: tuple[str, ...] = CARS) -> DataFrame:
    """Phones of a generation on and the cars, as targets."""
    phones = _targets(phone_targets(specifications(spark), from_generation), PHONE)
    return phones.unionByName(_targets(spark.createDataFrame([(c,) for c in cars], "query string"), CAR))


def pilot_fleet(spark: SparkSession) -> DataFrame:
    """The two targets that a new instance starts with."""
    return spark.createDataFrame(list(PILOT), TARGET)


def fleet_changes(stored: DataFrame, wanted: DataFrame, switch_off: bool = True) -> DataFrame:
    """Every target of either side as it should be, with ``change``: insert, update, deactivate or keep.

    One full outer join by category and query. What is wanted takes the wanted
    values and keeps its id, new ones get an id made from their key; stored
    targets that nobody wants are switched off (a seed that only adds does not,
    ``switch_off=False``) and never deleted. Applied again, every row is kept.
    ``wanted`` has one row a key; what else ``stored`` has stays as it is.
    """
    values = ["strict_filters", "is_active"]
    asked = wanted.select("category", "query", *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__wanted"))
    both = stored.withColumn("__stored", F.lit(True)).join(asked, ["category", "query"], "full_outer")
    is_wanted, is_stored = F.col("__wanted").isNotNull(), F.col("__stored").isNotNull()
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    change = F.when(~is_stored, "insert").when(is_wanted & same, "keep").when(is_wanted, "update").when(F.coalesce("is_active", F.lit(False)) & F.lit(switch_off), "deactivate").otherwise("keep")
    out = both.withColumns({
        "change": change, "id": F.coalesce(F.col("id").cast("string"), F.md5(F.concat_ws("|", "category", "query"))),
        "strict_filters": F.when(is_wanted, F.col("__strict_filters")).otherwise(F.col("strict_filters")), "is_active": F.when(is_wanted, F.col("__is_active")).when(F.col("is_active").isNotNull(), F.col("is_active") & F.lit(not switch_off)),
    })
    return out.select(*stored.columns, "change")


def active_fleet(targets: DataFrame, category: str | None = None) -> DataFrame:
    out = targets.filter(F.coalesce("is_active", F.lit(False)))
    return out.filter(F.col("category") == category) if category else out


def with_target_names(listings: DataFrame, targets: DataFrame) -> DataFrame:
    """``listings`` with ``target_name``, the query of their target; null without one."""
    return listings.join(targets.select(F.col("id").alias("target_id"), F.col("query").alias("target_name")), "target_id", "left")


def brand(model: Column) -> Column:
    """Apple for its devices, else the first word with a capital; Unknown for none."""
    lower, first = F.lower(model), F.split_part(F.regexp_replace(F.trim(model), r"\s+", " "), F.lit(" "), F.lit(1))
    return F.when(lower.contains("iphone") | lower.contains("ipad"), "Apple").when(F.coalesce(first, F.lit("")) == "", "Unknown").otherwise(F.initcap(first))


def products_for(stored: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The products that ``wanted`` (model, category) still lacks, and the product of every wanted row (model, category, product_id)."""
    asked = wanted.select("model", "category").distinct()
    known = stored.select("model", "category", F.col("id").alias("product_id"))
    all_of = asked.join(known, ["model", "category"], "left").withColumns({"__new": F.col("product_id").isNull(), "product_id": F.coalesce("product_id", F.md5(F.concat_ws("|", "category", "model")))})
    new = all_of.filter("__new").select(F.col("product_id").alias("id"), "model", "category", brand(F.col("model")).alias("brand"))
    return new, all_of.drop("__new")
