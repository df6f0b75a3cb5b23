"""Deduplication, upserts, matches and merges between a batch and what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.params import DEFAULTS, Params


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def only_new(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return batch.join(stored.select(key), key, "left_anti")


def only_known(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return batch.join(stored.select(key), key, "left_semi")


def upserted(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``stored`` with the rows of ``batch`` in the place of those with their keys; columns of either are kept."""
    both = stored.withColumn("__turn", F.lit(0)).unionByName(batch.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, [F.desc("__turn"), *order]).drop("__turn")


def price_drops(batch: DataFrame, stored: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """``(key, old_price, new_price, drop_pct)`` of listings that have become cheaper; rises are not events."""
    met = batch.select(key, F.col("price").alias("new_price")).join(stored.select(key, F.col("price").alias("old_price")), key)
    return met.filter(F.col("new_price") < F.col("old_price")).withColumn("drop_pct", S.percent(F.col("old_price") - F.col("new_price"), F.col("old_price")))


def alerts_to_send(candidates: DataFrame, sent: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Deals with a score that is high enough and an alert key that has not been sent."""
    wanted = candidates.filter((F.col("deal_class") == "affare") & (F.col("score") >= params.alert_min_score))
    return wanted.join(sent.select("listing_id", "alert_type"), ["listing_id", "alert_type"], "left_anti")


def drop_alerts(drops: DataFrame, saved: DataFrame, sent: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Falls worth an alert: large ones once, and every fall of a saved listing, by its new price."""
    marked = drops.join(saved.select("listing_id", F.lit(True).alias("saved")), "listing_id", "left")
    kept = marked.filter(F.col("saved") | (F.col("drop_pct") >= params.alert_min_drop_pct))
    kind = F.when(F.col("saved"), F.concat(F.lit("saved_drop:"), F.col("new_price").cast("long").cast("string"))).otherwise("price_drop")
    return kept.withColumn("alert_type", kind).drop("saved").join(sent.select("listing_id", "alert_type"), ["listing_id", "alert_type"], "left_anti")


def republished(new: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """``(new_id, old_id)``: the first new listing of each fingerprint takes the first stored one, and no other does."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return first_of(df.filter(F.col(fingerprint).isNotNull()), [fingerprint], [F.col(key)]).select(fingerprint, F.col(key).alias(name))

    return numbered(new, "new_id").join(numbered(stored, "old_id"), fingerprint).select("new_id", "old_id")


def removed(active: DataFrame, liveness: DataFrame) -> DataFrame:
    """Active listings that are gone: answered 404 or 410, or led to another listing; errors keep them."""
    from tallymart.functions.text import id_of_url

    met = active.join(liveness, "listing_url")
    before, after = id_of_url(F.col("listing_url")), id_of_url(F.col("final_url"))
    moved = (F.col("status_code") < 400) & before.isNotNull() & after.isNotNull() & (before != after)
    return met.filter(F.col("error").isNull() & (F.col("status_code").isin(404, 410) | moved)).select(*active.columns)


def merged(stored: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``stored`` and the rows of ``other`` with new keys, over the columns both have; merging again changes nothing."""
    shared = [c for c in stored.columns if c in other.columns]
    return stored.unionByName(first_of(only_new(other, stored, key), [key], [F.col(c) for c in shared if c != key]).select(*shared), allowMissingColumns=True)
