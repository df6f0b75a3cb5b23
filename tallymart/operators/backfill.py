"""Deep backfills: landed pages into listings, and variants of stored listings that are out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import text as T
from tallymart.operators import fleet, listings
from tallymart.params import DEFAULTS, Params
from tallymart.staging import stage, unstage

MAX_PAGES = 10


def backfill_fleet(targets: DataFrame, category: str | None = None, query_part: str | None = None) -> DataFrame:
    """Active targets of a category whose query holds a text, whatever its case."""
    out = fleet.active_fleet(targets, category)
    return out.filter(F.contains(F.lower("query"), F.lit(query_part.lower()))) if query_part else out


def backfill_totals(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Per target: ads scraped, urls that are new, known ones, and known ones that ask less than what is stored.

    ``found`` (target, listing_url, price) may show an url on several pages:
    its lowest price counts.
    """
    once = found.groupBy("target", "listing_url").agg(F.count("*").alias("seen"), F.min("price").alias("price"))
    met = once.join(stored.select("listing_url", F.col("price").alias("stored_price"), F.lit(True).alias("known")), "listing_url", "left")
    known = F.coalesce("known", F.lit(False))
    return met.groupBy("target").agg(F.sum("seen").alias("scraped"), F.count_if(~known).alias("new"), F.count_if(known).alias("updated"), F.count_if(F.coalesce(F.col("price") < F.col("stored_price"), F.lit(False))).alias("price_drops"))


def admitted(found: DataFrame, category: str, params: Params = DEFAULTS) -> DataFrame:
    """What a backfill takes of scanned ads: those inside the price bounds of their kind; no title match, no accessories left out."""
    return found.filter(listings.price_in_bounds(F.lit(category), F.col("price"), params))


def variant_changes(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """The listings whose variant, condition or colour is not what their title, storage and target say now, with the new values.

    Compared null-safely; a colour that the title does not name stays. Columns
    as ``stored``: id, title, category, target_id, storage_gb, defects_noted,
    features, variant_key, tier, color and others.
    """
    wish = F.from_json("strict_filters", "min_year int, max_year int")
    of_target = targets.select(F.col("id").alias("target_id"), F.col("query").alias("__query"), wish.alias("__wish"))
    met = stored.join(of_target, "target_id", "left")
    is_car = F.col("category") == "automobile"
    query = F.when(is_car, F.col("__query"))
    none = F.array().cast("array<string>")
    now = {
        "variant_key": listings.variant_key(F.col("category"), F.col("title"), F.col("storage_gb"), query, F.when(is_car, F.col("__wish.min_year")), F.when(is_car, F.col("__wish.max_year"))),
        "tier": listings.condition_tier(F.col("category"), F.coalesce("defects_noted", none), F.coalesce("features", none)),
        "color": F.coalesce(T.first_tag(T.folded(F.coalesce("title", F.lit(""))), T.COLORS), F.col("color")),
    }
    told = met.withColumns({f"__{c}": v for c, v in now.items()})
    differs = F.lit(False)
    for c in now:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return told.filter(differs).select(*[F.col(f"__{c}").alias(c) if c in now else F.col(c) for c in stored.columns])


def backfill_variants(spark: SparkSession, path: str, targets: DataFrame, partition: str) -> int:
    """Bring a Parquet table partitioned by ``partition`` up to date; returns how many listings changed.

    Only partitions with a change are written, with Spark's dynamic partition
    overwrite, from a copy that is complete before the first file is replaced.
    Without a change nothing is written. Ids are unique.
    """
    stored = spark.read.parquet(path)
    changed = stage(variant_changes(stored, targets), "variants")
    n = changed.count()
    if n:
        touched = stored.join(changed.select(partition).distinct(), partition, "left_semi")
        rest = touched.join(changed.select("id"), "id", "left_anti")
        whole = stage(rest.select(*stored.columns).unionByName(changed.select(*stored.columns)), "partitions")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        unstage(whole)
    unstage(changed)
    return n
