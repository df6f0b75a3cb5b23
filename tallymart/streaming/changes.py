"""What a stream of ads and probes changes, listing by listing, and one round of alerts a run, with Spark's own keyed state.

State lies in Spark's state store by key, so a micro-batch reads and writes
what it brings and no more, however many rounds went before: alerts their
run, listings the bucket of urls that each is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallymart.functions.text import id_of_url
from tallymart.session import ship_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LISTINGS = "url array<string>, price array<double>, found array<bigint>, active array<boolean>"
CHANGES = "listing_url string, change string, old_price double, new_price double, drop_pct double, days double, at timestamp"
_MICROS_A_DAY = 86_400_000_000
ALERTS = "category string, run string, nth int, listing_id string, score double, alerts int"

#: What happened to a listing: seen first, cheaper, gone.
NEW, DROP, SOLD = "new", "drop", "sold"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Listings(StatefulProcessor):
    """Of the urls of one bucket: the price each asks, since when it is known, and whether it is still there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("listings", _LISTINGS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = {url: rest for url, *rest in zip(*(self.held.get() or ()), strict=True)}
        change = lambda url, what, at, old=None, new=None, fall=None, days=None: Row(listing_url=url, change=what, old_price=old, new_price=new, drop_pct=fall, days=days, at=at)
        batch = [(r["at"], r["gone"], -(r["price"] or 0), r["listing_url"], r["price"]) for r in rows]
        touched = False
        for at, gone, _, url, price in sorted(batch, key=lambda r: r[:3]):
            one = known.get(url)
            if gone:
                if one is None or not one[2]:
                    continue
                one[2] = False
                yield change(url, SOLD, at, old=one[0], days=(at - one[1]) / _MICROS_A_DAY)
            elif one is None:
                known[url] = [price, at, True]
                yield change(url, NEW, at, new=price)
            elif price < one[0]:
                before, one[0] = one[0], price
                yield change(url, DROP, at, old=before, new=price, fall=(before - price) / before * 100 if before else None)
            else:
                continue
            touched = True
        if touched:
            self.held.update(tuple(map(list, zip(*((url, *one) for url, one in known.items()), strict=True))))

    def close(self) -> None:
        pass


def listing_changes(ads: DataFrame, probes: DataFrame | None = None, buckets: int = 65_536) -> DataFrame:
    """A stream of changes from streams of ads (listing_url, price, at) and probes (listing_url, status_code, final_url, error, at).

    A url is new once. A lower price than the last one is a drop, a higher one
    changes nothing. A probe that answers 404 or 410, or leads to another
    listing, sells an active listing, with its days since it was found; errors
    change nothing, and a sold listing does not come back. Rows of a batch go
    by time, of equal times the highest price first, probes last. Ads without
    url or price, and probes of unknown urls, are ignored.

    Urls share calls of Python and of the state store by ``buckets``, which a
    checkpoint fixes: a batch reads the buckets of its urls and rewrites those
    with a change, so they should hold some hundreds of listings.
    """
    every = ads.select("listing_url", F.col("price").cast("double").alias("price"), "at", F.lit(False).alias("gone"))
    if probes is not None:
        before, after = id_of_url(F.col("listing_url")), id_of_url(F.col("final_url"))
        moved = F.coalesce((F.col("status_code") < 400) & (before != after), F.lit(False))
        gone = F.col("error").isNull() & (F.coalesce(F.col("status_code").isin(404, 410), F.lit(False)) | moved)
        every = every.unionByName(probes.filter(gone).select("listing_url", F.lit(None).cast("double").alias("price"), "at", F.lit(True).alias("gone")))
    known = every.filter(F.col("listing_url").isNotNull() & F.col("at").isNotNull() & (F.col("gone") | F.col("price").isNotNull())).withColumn("at", F.unix_micros("at"))
    keyed = known.withColumn("bucket", F.pmod(F.xxhash64("listing_url"), F.lit(buckets)))
    found = keyed.groupBy("bucket").transformWithState(statefulProcessor=_Listings(), outputStructType=CHANGES.replace("at timestamp", "at long"), outputMode="Append", timeMode="None")
    return found.withColumn("at", F.timestamp_micros("at"))


class _Round(StatefulProcessor):
    """Of one category and run: the best score of each listing so far, until the run is over."""

    def __init__(self, delay_ms: int, top: int) -> None:
        self.delay_ms, self.top = delay_ms, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "listing_id string", "score double")
        self.close_at = handle.getValueState("close_at", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, watermark = None, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r["run_ms"] < watermark:
                continue
            one = (r["listing_id"],)
            before = self.scores.getValue(one) if self.scores.containsKey(one) else None
            if before is None or r["score"] > before[0]:
                self.scores.updateValue(one, (r["score"],))
            last = r["run_ms"] if last is None else max(last, r["run_ms"])
        if last is not None:
            due, set_ = last + self.delay_ms, self.close_at.get()
            if set_ is None or set_[0] < due:
                if set_ is not None:
                    self.handle.deleteTimer(set_[0])
                self.handle.registerTimer(due)
                self.close_at.update((due,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        import heapq

        pairs = [(k[0], v[0]) for k, v in self.scores.iterator()]
        for nth, (name, score) in enumerate(heapq.nsmallest(self.top, pairs, key=lambda p: (-p[1], p[0])), 1):
            yield Row(category=key[0], run=key[1], nth=nth, listing_id=name, score=score, alerts=len(pairs))
        self.scores.clear()
        self.close_at.clear()

    def close(self) -> None:
        pass


def alert_rounds(candidates: DataFrame, delay_seconds: int = 60, top: int = 50) -> DataFrame:
    """One round of alerts for each category and run, once the run is over.

    ``candidates`` (category, run, listing_id, score, run_at) is a stream; a
    run is over when event time, the latest ``run_at`` seen less
    ``delay_seconds``, has passed its own latest ``run_at`` by as much again.
    Until then its candidates wait in the state, each listing with its best
    score, so that several batches of a run give one round: the ``top`` best
    by score and id, with how many there were. Rows older than event time are
    late and dropped, so a run is never told twice for them; the rows of a run
    lie within ``delay_seconds`` of each other. Rows without listing or score
    are ignored.
    """
    wanted = candidates.filter(F.col("listing_id").isNotNull() & F.col("score").isNotNull()).withColumn("run_ms", F.unix_millis("run_at"))
    timed = wanted.withWatermark("run_at", f"{delay_seconds} seconds")
    return timed.groupBy("category", "run").transformWithState(statefulProcessor=_Round(delay_seconds * 1000, top), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")


def run_to_files(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take all that is there as micro-batches and add what comes of it to Parquet files, exactly once."""
    spark = changes.sparkSession
    ship_package(spark)
    with keyed_state(spark):
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
