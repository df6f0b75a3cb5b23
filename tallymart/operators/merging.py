"""Another instance's targets, listings and price history into ours: new rows only, under our targets' ids."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators.incremental import first_of
from tallymart.sources.batches import is_published, publish

TABLES = ("targets", "listings", "history")


def target_map(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(their_id, our_id, is_new)`` by category and query; a target that we lack keeps its id and is new."""
    known = first_of(ours, ["category", "query"], [F.col("id")]).select("category", "query", F.col("id").alias("our_id"))
    met = theirs.select(F.col("id").alias("their_id"), "category", "query").join(known, ["category", "query"], "left")
    return met.select("their_id", F.coalesce("our_id", "their_id").alias("our_id"), F.col("our_id").isNull().alias("is_new"))


@dataclass(frozen=True)
class Merge:
    """What a merge would add to each table, what it leaves out and why, and what was looked at."""

    added: Mapping[str, DataFrame]
    looked_at: Mapping[str, DataFrame]
    left_out: DataFrame

    def counts(self) -> DataFrame:
        """A dry run: per table, rows looked at and rows that would be added; nothing is written."""
        out = None
        for name in TABLES:
            n = self.looked_at[name].agg(F.count("*").alias("candidates")).join(self.added[name].agg(F.count("*").alias("added")))
            row = n.select(F.lit(name).alias("table"), "candidates", "added")
            out = row if out is None else out.unionByName(row)
        return out

    def publish(self, spark: SparkSession, folder: str, name: str) -> None:
        """All tables at once, as the batch ``name``; a merge that has been published is left alone."""
        if not is_published(spark, folder, name):
            publish(spark, folder, name, self.added)


def plan_merge(ours: Mapping[str, DataFrame], theirs: Mapping[str, DataFrame]) -> Merge:
    """What to add to ``ours`` (targets, listings, history) from ``theirs``.

    Targets are matched by category and query, and their ids in listings are
    translated. A listing comes in unless its url is ours, over the columns
    that both sides have; of equal urls of theirs the first by id. Listings of
    an unknown target, and those whose id we use for another url, stay out and
    are reported. History comes in for listings that are ours afterwards, by
    id, unless its own id is there. Once added, the same merge adds nothing.
    """
    mapping = target_map(ours["targets"], theirs["targets"])
    shared = {t: [c for c in theirs[t].columns if c in ours[t].columns] for t in TABLES}
    new = mapping.filter("is_new").select(F.col("their_id").alias("id"))
    targets = first_of(theirs["targets"].join(new, "id", "left_semi"), ["category", "query"], [F.col("id")]).select(*shared["targets"])
    met = theirs["listings"].join(mapping.select(F.col("their_id").alias("target_id"), F.col("our_id").alias("__ours")), "target_id", "left")
    lost = F.col("target_id").isNotNull() & F.col("__ours").isNull()
    mapped = first_of(met.filter(~lost).withColumn("target_id", F.col("__ours")).drop("__ours"), ["listing_url"], [F.col("id")])
    unknown = mapped.join(ours["listings"].select("listing_url"), "listing_url", "left_anti")
    taken = ours["listings"].select("id")
    listings = unknown.join(taken, "id", "left_anti").select(*shared["listings"])
    why = lambda df, reason: df.select("id", "listing_url", F.lit(reason).alias("reason"))
    left_out = why(met.filter(lost), "unknown target").unionByName(why(unknown.join(taken, "id", "left_semi"), "id in use"))
    present = ours["listings"].select("id").unionByName(listings.select("id")).join(mapped.select("id"), "id", "left_semi").distinct()
    events = theirs["history"].join(present.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").join(ours["history"].select("id"), "id", "left_anti")
    history = first_of(events, ["id"], [F.col(c) for c in events.columns if c != "id"]).select(*shared["history"])
    return Merge({"targets": targets, "listings": listings, "history": history}, {"targets": theirs["targets"], "listings": mapped, "history": theirs["history"]}, left_out)
