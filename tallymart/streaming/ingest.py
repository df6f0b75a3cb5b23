"""Micro-batches of ads into stored listings: new, seen again, republished and removed ones, price drops, and alerts that go out once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymart.functions import stats as S
from tallymart.functions.text import holds_all_words
from tallymart.operators import enrichment, history, incremental, listings
from tallymart.params import ACTIVE, CAR, DEFAULTS, PHONE, Params
from tallymart.sources.ads import ads_of, read_pages
from tallymart.sources.store import Rounds, Store
from tallymart.staging import stage, unstage

#: What a round did to a listing.
NEW, SEEN, MOVED, REMOVED = "new", "seen", "moved", "removed"


@dataclass
class Market:
    """The tables of one market, under a folder that all executors reach.

    ``on_alerts`` is given the alerts of a batch, once they are on record; a
    batch that is tried again gives it the same ones again.
    """

    spark: SparkSession
    folder: str
    params: Params = DEFAULTS
    category: str = PHONE
    query: str | None = None
    on_alerts: Callable[[DataFrame], None] | None = None

    def store(self, name: str) -> Store:
        return Store(self.spark, f"{self.folder}/{name}")

    def rounds(self, name: str) -> Rounds:
        return Rounds(self.spark, f"{self.folder}/{name}")

    def listings(self) -> DataFrame:
        """Every listing as the last round that touched it left it; there must be one."""
        return self.rounds("listings").latest("id").drop(Rounds.NUMBER, "change")

    def price_history(self) -> DataFrame | None:
        """``(listing_id, listing_url, old_price, new_price, drop_pct, changed_at)``."""
        events = self.rounds("price_history").read()
        return None if events is None else events.drop(Rounds.NUMBER)

    def prepare(self, ads: DataFrame) -> DataFrame:
        """Parsed ads of this market that are in bounds and sell no accessory, one for each url.

        ``ads`` may bring ``image_hash``, the fingerprint of the first image.
        """
        if "image_hash" not in ads.columns:
            ads = ads.withColumn("image_hash", F.lit(None).cast("string"))
        parsed = listings.parse_listings(ads).withColumn("category", F.lit(self.category))
        parsed = parsed.withColumns({"year": F.coalesce("ad_year", "year"), "km": F.coalesce("ad_km", "km")})
        kept = parsed.filter(listings.price_in_bounds(F.col("category"), F.col("price"), self.params) & ~F.col("is_accessory"))
        if self.query:
            kept = kept.filter(holds_all_words(F.col("title"), F.lit(self.query)))
        none, query = F.lit(None).cast("int"), F.lit(self.query)
        kept = kept.withColumns({"variant_key": listings.variant_key(F.col("category"), F.col("title"), F.col("storage_gb"), query, none, none), "tier": listings.condition_tier(F.col("category"), F.col("defects_noted"), F.col("features")), "status": F.lit("nuovo")})
        return incremental.first_of(kept, ["listing_url"], [F.col("price"), *[F.col(c) for c in kept.columns if c not in ("listing_url", "price")]])

    def _touched(self, batch: DataFrame, before: DataFrame, moves: DataFrame) -> DataFrame:
        """Stored listings that the batch shows again or under a new url, with what it says of them.

        A row without images takes those of the ad; a lower price becomes the
        price and the one before it the original price; a higher one is ignored.
        """
        seen = batch.select("listing_url", F.col("price").alias("__price"), F.col("image_urls").alias("__images"), F.col("image_hash").alias("__hash"), F.col("updated_at").alias("__seen"))
        rows = before.join(seen, "listing_url", "left").join(moves, "id", "left").filter(F.col("__seen").isNotNull() | F.col("__url").isNotNull())
        bare, shown = F.coalesce(F.size("image_urls"), F.lit(0)) <= 0, F.coalesce(F.size("__images"), F.lit(0)) > 0
        heals, cheaper = F.col("__seen").isNotNull() & bare & shown, F.coalesce(F.col("__price") < F.col("price"), F.lit(False))
        gallery = F.when(F.coalesce(F.size("__gallery"), F.lit(0)) > 0, F.col("__gallery"))
        return rows.select(
            *[F.col(c) for c in before.columns if c not in ("listing_url", "image_urls", "image_hash", "price", "original_price", "updated_at", "change")],
            F.coalesce("__url", "listing_url").alias("listing_url"), F.coalesce(gallery, F.when(heals, F.col("__images")), F.col("image_urls")).alias("image_urls"), F.when(heals, F.coalesce("__hash", "image_hash")).otherwise(F.col("image_hash")).alias("image_hash"),
            F.when(cheaper, F.col("__price")).otherwise(F.col("price")).alias("price"), F.when(cheaper, F.col("price")).otherwise(F.col("original_price")).alias("original_price"), F.when(cheaper, F.col("price")).alias("old_price"),
            F.coalesce("__seen", "__moved").alias("updated_at"), F.when(F.col("__url").isNotNull(), MOVED).otherwise(SEEN).alias("change"),
        )

    def _reclassified(self, fresh: DataFrame, before: DataFrame) -> DataFrame:
        """New private listings of cars whose seller has too many, stored ones and those of the batch together."""
        if self.category != CAR:
            return fresh
        private = fresh.filter(F.col("seller_type") == "privato")
        active = before.filter(F.col("status").isin(*ACTIVE)).join(private.select("seller_id").distinct(), "seller_id", "left_semi")
        flagged = history.needs_reclassifying(active, private, self.params).select("seller_id", F.lit(True).alias("__flag"))
        kind = F.when(F.col("__flag") & (F.col("seller_type") == "privato"), "finto_privato").otherwise(F.col("seller_type"))
        return fresh.join(flagged, "seller_id", "left").withColumn("seller_type", kind).select(*fresh.columns)

    def apply(self, ads: DataFrame, batch_id: int) -> None:
        """One batch: price changes, then all listings it touches as one round, then its alerts.

        The round of listings is the mark that the batch has been applied.
        Until it is complete, stored listings are as before and a retry makes
        the same again; from then on they and the history are left alone.
        """
        name = f"batch{batch_id}"
        stored, events = self.rounds("listings"), self.rounds("price_history")
        if not stored.holds(name):
            prepared = self.prepare(ads).withColumns({"id": F.md5(F.concat("listing_url", F.lit(f"|{name}"))), "found_at": F.current_timestamp(), "original_price": F.lit(None).cast("double"), "sold_at": F.lit(None).cast("timestamp")})
            batch = stage(prepared.withColumns({"updated_at": F.col("found_at"), "change": F.lit(NEW)}), "batch")
            before = stored.latest("id")
            before = batch.filter(F.lit(False)) if before is None else before.drop(Rounds.NUMBER)
            unknown = incremental.only_new(batch, before, "listing_url")
            pairs = stage(incremental.republished(unknown, before, "id", "image_hash"), "republished")
            moves = unknown.join(pairs, unknown["id"] == pairs["new_id"]).select(F.col("old_id").alias("id"), F.col("listing_url").alias("__url"), F.col("image_urls").alias("__gallery"), F.col("updated_at").alias("__moved"))
            touched = stage(self._touched(batch, before, moves), "touched")
            fallen = touched.filter(F.col("old_price").isNotNull())
            events.put(name, fallen.select(F.col("id").alias("listing_id"), "listing_url", "title", "old_price", F.col("price").alias("new_price"), S.percent(F.col("old_price") - F.col("price"), F.col("old_price")).alias("drop_pct"), F.col("updated_at").alias("changed_at")))
            fresh = self._reclassified(unknown.join(pairs.select(F.col("new_id").alias("id")), "id", "left_anti"), before)
            stored.put(name, fresh.unionByName(touched.drop("old_price"), allowMissingColumns=True))
            for done in (batch, pairs, touched):
                unstage(done)
        if self.on_alerts is not None:
            self.on_alerts(self.alerts_of(name))

    def alerts_of(self, name: str, saved: DataFrame | None = None) -> DataFrame:
        """Alerts of a round that had not gone out, deals among its new listings and falls of price; on record before they are returned.

        ``saved`` has the ``listing_id`` of listings whose every fall is told.
        """
        claimed = self.rounds("sent_alerts")
        if not claimed.holds(name):
            now, falls = self.rounds("listings").latest("id"), self.rounds("price_history")
            now = now.withColumns({"model": listings.model_key(F.col("variant_key")), "has_photo": F.coalesce(F.size("image_urls"), F.lit(0)) > 0})
            number = self.rounds("listings").of(name).agg(F.max(Rounds.NUMBER)).first()[0]
            new = now.filter((F.col(Rounds.NUMBER) == F.lit(number)) & (F.col("change") == NEW))
            rich = enrichment.enrich(now, F.current_timestamp(), rows=new, changes=falls.read().drop(Rounds.NUMBER), km_key="model", params=self.params)
            deals = rich.select(F.col("id").alias("listing_id"), F.lit("deal").alias("alert_type"), "deal_class", "score", "title", "listing_url", "price", "fair_value", "margin_pct", "max_bid")
            sent = claimed.read()
            sent = self.spark.createDataFrame([], "listing_id string, alert_type string") if sent is None else sent.select("listing_id", "alert_type")
            saved = self.spark.createDataFrame([], "listing_id string") if saved is None else saved.select("listing_id").distinct()
            drops = incremental.drop_alerts(falls.of(name).drop(Rounds.NUMBER), saved, sent, self.params)
            return self.claim_alerts(incremental.alerts_to_send(deals, sent, self.params).unionByName(drops, allowMissingColumns=True), name)
        return claimed.of(name).drop(Rounds.NUMBER)

    def claim_alerts(self, candidates: DataFrame, name: str | None = None) -> DataFrame:
        """Alerts that had not gone out; they are on record before they are returned."""
        claimed, keys = self.rounds("sent_alerts"), ["listing_id", "alert_type"]
        fresh = incremental.first_of(candidates, keys, [F.col(c) for c in candidates.columns if c not in keys] or [F.lit(1)])
        sent = claimed.read()
        if sent is not None:
            fresh = fresh.join(sent.select(*keys), keys, "left_anti")
        return claimed.put(name or uuid.uuid4().hex, fresh).drop(Rounds.NUMBER)

    def mark_removed(self, liveness: DataFrame) -> None:
        """Active listings that are gone become sold, as a round of their own."""
        stored = self.rounds("listings")
        active = stored.latest("id").drop(Rounds.NUMBER).filter(F.col("status").isin(*ACTIVE))
        gone = active.join(incremental.removed(active, liveness).select("id").distinct(), "id", "left_semi").select(*active.columns)
        at = F.current_timestamp()
        stored.put(f"removed{uuid.uuid4().hex}", gone.withColumns({"status": F.lit("venduto_rimosso"), "updated_at": at, "sold_at": at, "change": F.lit(REMOVED)}))

    def record_run(self, run: DataFrame) -> DataFrame:
        """Append runs (id, category, targets, ok, failed, scraped, new_count, ran_at) and return the transitions among all."""
        status = history.run_status(F.col("targets"), F.col("ok"), F.col("failed"), F.col("scraped"))
        return history.health_transitions(self.store("scrape_runs").append(run.withColumn("status", status)))


def ingest_stream(market: Market, landing: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """All pages that have landed, in micro-batches; run again to take what lands later."""
    pages = read_pages(market.spark, landing, stream=True, files_per_batch=files_per_batch)
    return ads_of(pages).writeStream.foreachBatch(market.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
