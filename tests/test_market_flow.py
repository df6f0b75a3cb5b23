"""Stores, streaming ingest and the engine, end to end on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymart.engine import Engine
from tallymart.operators import alerts, feed, history, incremental, market
from tallymart.sources.ads import ads_of, read_pages
from tallymart.sources.store import Rounds, Store, check_valid
from tallymart.streaming import Market, inflow, ingest_stream


def ad(n, price, title="iPhone 13 128GB", body="perfette condizioni, batteria 90%"):
    return {
        "subject": title, "body": body, "urls": {"default": f"https://x.it/iphone-{n}.htm"}, "features": [{"uri": "/price", "values": [{"key": str(price), "value": f"{price} €"}]}], "images": [{"cdn_base_url": "i"}],
        "geo": {"town": {"value": "Roma"}}, "advertiser": {"user_id": str(n % 3), "company": n % 2 == 0},
    }


def land(folder, name, ads):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"ads": ads, "count_all": len(ads)}))


def test_ads_are_flattened(spark, tmp_path):
    land(tmp_path / "l", "1.json", [ad(1, 500), ad(2, 450)])
    rows = ads_of(read_pages(spark, str(tmp_path / "l"))).orderBy("listing_url").collect()
    assert [(r.price, r.location, r.seller_type) for r in rows] == [(500.0, "Roma", "privato"), (450.0, "Roma", "dealer")]


def test_stream_ingests_once_and_sees_drops(spark, tmp_path):
    market = Market(spark, f"file://{tmp_path}/market")
    land(tmp_path / "l", "1.json", [ad(1, 500), ad(2, 450), ad(2, 460), ad(3, 20), ad(4, 30, "Cover per iPhone 13")])
    ingest_stream(market, f"file://{tmp_path}/l", f"file://{tmp_path}/c").awaitTermination()
    first = {r.listing_url: r.price for r in market.listings().collect()}
    assert first == {"https://x.it/iphone-1.htm": 500.0, "https://x.it/iphone-2.htm": 450.0}
    land(tmp_path / "l", "2.json", [ad(1, 400), ad(2, 470), ad(5, 300)])
    ingest_stream(market, f"file://{tmp_path}/l", f"file://{tmp_path}/c").awaitTermination()
    now = {r.listing_url: (r.price, r.original_price) for r in market.listings().collect()}
    assert now == {"https://x.it/iphone-1.htm": (400.0, 500.0), "https://x.it/iphone-2.htm": (450.0, None), "https://x.it/iphone-5.htm": (300.0, None)}
    assert [(r.old_price, r.new_price) for r in market.price_history().collect()] == [(500.0, 400.0)]
    market.apply(ads_of(read_pages(spark, str(tmp_path / "l"))), 1)
    assert market.price_history().count() == 1
    alive = spark.createDataFrame([("https://x.it/iphone-1.htm", 404, None, None), ("https://x.it/iphone-2.htm", 503, None, None), ("https://x.it/iphone-5.htm", 200, "https://x.it/altro-77.htm", None)], "listing_url string, status_code int, final_url string, error string")
    market.mark_removed(alive)
    assert {r.listing_url: r.status for r in market.listings().collect()} == {"https://x.it/iphone-1.htm": "venduto_rimosso", "https://x.it/iphone-2.htm": "nuovo", "https://x.it/iphone-5.htm": "venduto_rimosso"}


def phones(spark, rows):
    """Ads from (n, price, seller, images, hash)."""
    full = [(f"https://x.it/iphone-{n}.htm", "iPhone 13 128GB", "perfette condizioni", float(price), images, "Roma", seller, "privato", None, None, None, None, hash_) for n, price, seller, images, hash_ in rows]
    return spark.createDataFrame(full, "listing_url string, title string, description string, price double, image_urls array<string>, location string, seller_id string, seller_type string, ad_year int, ad_km int, transmission string, fuel string, image_hash string")


def test_republished_listing_moves_and_images_heal(spark, tmp_path):
    market = Market(spark, f"file://{tmp_path}/market")
    market.apply(phones(spark, [(1, 500, "a", ["i"], "h"), (2, 400, "b", [], None)]), 0)
    ids = {r.listing_url[-5]: r.id for r in market.listings().collect()}
    market.apply(phones(spark, [(7, 450, "a", ["j"], "h"), (8, 440, "a", ["k"], "h"), (2, 420, "b", ["m"], "g"), (1, 480, "a", ["i"], "h")]), 1)
    now = {r.listing_url[-5]: r for r in market.listings().collect()}
    assert set(now) == {"2", "8", "7"} and {r.id for r in now.values()} >= set(ids.values())
    moved = next(r for r in now.values() if r.id == ids["1"])
    assert (moved.price, moved.original_price) == (480.0, 500.0) and moved.image_urls in (["j"], ["k"])
    assert (now["2"].id, now["2"].price, now["2"].image_urls, now["2"].image_hash) == (ids["2"], 400.0, ["m"], "g")
    assert [(r.listing_id, r.old_price, r.new_price) for r in market.price_history().collect()] == [(ids["1"], 500.0, 480.0)]


def test_sellers_of_many_cars_are_no_private_ones(spark, tmp_path):
    market = Market(spark, f"file://{tmp_path}/market", category="automobile", query="iphone")
    market.apply(phones(spark, [(1, 5000, "a", [], None), (2, 5000, "a", [], None), (3, 5000, "b", [], None)]), 0)
    market.apply(phones(spark, [(4, 5000, "a", [], None), (5, 5000, "a", [], None), (6, 5000, "b", [], None), (7, 5000, None, [], None)]), 1)
    kinds = {r.listing_url[-5]: r.seller_type for r in market.listings().collect()}
    assert {n for n, kind in kinds.items() if kind == "finto_privato"} == {"4", "5"} and len(kinds) == 7


@pytest.mark.parametrize("lost", ["price_history", "listings", "sent_alerts"])
def test_batch_that_fails_between_writes_can_be_tried_again(spark, tmp_path, monkeypatch, lost):
    told = []
    market = Market(spark, f"file://{tmp_path}/market", on_alerts=lambda alerts: told.append(sorted((r.alert_type, r.price or r.new_price) for r in alerts.collect())))
    market.apply(phones(spark, [(n, 500 + n, f"s{n}", ["i"], None) for n in range(1, 6)]), 0)
    second = phones(spark, [(1, 300, "s1", ["i"], None), (8, 350, "s8", ["i"], None), (8, 350, "s8", ["i"], None)])
    put = Rounds.put

    def failing(self, name, df):
        if self.folder.endswith(lost):
            df.write.mode("overwrite").parquet(f"{self.folder}/r{9:012d}-{name}")
            marker = self._path(f"r{9:012d}-{name}/_SUCCESS")
            self._fs.delete(marker, False)
            raise OSError("lost")
        return put(self, name, df)

    monkeypatch.setattr(Rounds, "put", failing)
    with pytest.raises(OSError):
        market.apply(second, 1)
    monkeypatch.setattr(Rounds, "put", put)
    told.clear()
    for _ in range(2):
        market.apply(second, 1)
    assert sorted(r.price for r in market.listings().collect()) == [300.0, 350.0, 502.0, 503.0, 504.0, 505.0]
    assert [(r.old_price, r.new_price) for r in market.price_history().collect()] == [(501.0, 300.0)]
    assert told == [[("deal", 350.0), ("price_drop", 300.0)]] * 2
    market.rounds("listings").fold("id", "folded")
    assert market.listings().count() == 6


def test_alerts_go_out_once(spark, tmp_path):
    market = Market(spark, f"file://{tmp_path}/market")
    wanted = spark.createDataFrame([(1, "affare"), (2, "affare"), (2, "affare")], "listing_id long, alert_type string")
    assert market.claim_alerts(wanted).count() == 2
    assert market.claim_alerts(wanted.unionAll(spark.createDataFrame([(3, "affare")], wanted.schema))).collect() == [(3, "affare")]


def test_runs_report_transitions(spark, tmp_path):
    market = Market(spark, f"file://{tmp_path}/market")
    rows = [(i, "tech", 5, ok, 0, 9, 1, f"2024-01-0{i + 1} 00:00:00") for i, ok in enumerate((5, 0, 0, 5))]
    runs = spark.createDataFrame(rows, "id int, category string, targets int, ok int, failed int, scraped int, new_count int, ran_at string")
    assert [(r.id, r.transition) for r in market.record_run(runs).orderBy("id").collect()] == [(1, "went_down"), (3, "recovered")]


def test_store_verbs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert not store.exists()
    store.upsert(rows, ["k"])
    twice = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sorted(map(tuple, store.upsert(twice, ["k"]).collect()))
    assert once == sorted(map(tuple, store.upsert(twice, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in store.insert_new(spark.createDataFrame([(3, "x"), (4, "y")], "k int, v string"), ["k"]).collect()] == [(4, "y")]
    store.update(F.col("k") == 1, {"v": F.lit("z")})
    assert sorted(map(tuple, store.delete(F.col("k") > 2).collect())) == [(1, "z"), (2, "c")]
    assert check_valid(store.read(), ["k"], ["v"], {"short": F.length("v") == 1}) == {}
    assert check_valid(rows.unionAll(rows), ["k"]) == {"unique k": 2}


def test_merging_again_changes_nothing(spark):
    mine = spark.createDataFrame([(1, "a", 1)], "k int, v string, w int")
    other = spark.createDataFrame([(1, "x"), (2, "b"), (2, "b")], "k int, v string")
    once = incremental.merged(mine, other, "k")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, incremental.merged(once, other, "k").collect()), key=str) and once.count() == 2


def test_republished_pairs_are_one_to_one(spark):
    new = spark.createDataFrame([(10, "h"), (11, "h"), (12, None), (13, "g")], "id int, hash string")
    old = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "id int, hash string")
    assert [tuple(r) for r in incremental.republished(new, old, "id", "hash").collect()] == [(10, 1)]


def test_engine_answers(spark):
    rows = [(i, i % 4, "m", "v", "smartphone", 100.0 + i % 40, "nuovo" if i % 3 else "venduto_rimosso", "buono", f"2024-01-{1 + i % 20:02d} 00:00:00", f"2024-01-{5 + i % 20:02d} 00:00:00", 128, "Nero", "Casa <b>", "Roma") for i in range(60)]
    table = spark.createDataFrame(rows, "id int, seller_id int, model string, variant_key string, category string, price double, status string, tier string, f string, s string, storage_gb int, color string, title string, location string")
    table = table.withColumns({"found_at": F.col("f").cast("timestamp"), "sold_at": F.when(F.col("status") == "venduto_rimosso", F.col("s").cast("timestamp"))})
    engine = Engine(table, F.lit("2024-01-31").cast("timestamp"))
    got = engine.opportunities(feed.Wanted(category="smartphone", text=" CASA ", max_price=120), size=5).collect()
    assert len(got) == 5 and [r.margin_pct for r in got] == sorted((r.margin_pct for r in got), reverse=True)
    assert engine.opportunities(feed.Wanted(deal_classes=())).count() == 0
    report = engine.market_intelligence().first()
    assert (report.volume, report.sold, report.avg_days) == (40, 20, 4.0) and report.level in ("alta", "media", "bassa")
    assert engine.time_to_sale().filter("level = 7").first().n == 20
    assert {r.facet for r in engine.facets().collect()} == {"model", "storage_gb", "color", "tier"}
    assert engine.with_settings(deal_pct=0.1).valued().filter("deal_class = 'affare'").count() > engine.valued().filter("deal_class = 'affare'").count()
    text = engine.valued().select(alerts.deal_alert(F.col("title"), F.col("price"), F.col("fair_value"), F.lit(None).cast("double"), F.lit(60), F.col("max_bid"), F.lit("u")).alias("t")).first().t
    assert text.startswith("<b>Casa &lt;b&gt;</b>\nPrezzo: 1") and "Margine" not in text


def test_windows_slide(spark):
    rows = spark.createDataFrame([("m", "2024-01-10 12:00:00"), ("m", "2024-01-11 12:00:00")], "model string, found_at string")
    counts = [r.inflow for r in inflow(rows).collect()]
    assert sorted(counts) == [1, 1] + [2] * 6


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.columns == ["id", "variant_key", "price", "fair_value", "margin_eur", "margin_pct", "deal_class"] and first.count() > 0


@pytest.mark.parametrize("name", ["fair_value_deal_class", "price_position", "time_to_sale_cube", "seller_profile", "depreciation_lag"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tallymart.plans.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    columns = wanted.columns
    key = lambda r: tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, wanted.fetchall()))


def test_km_models_fit_all_rows(spark):
    rows = [(i, i, "m", 10.0 + i, 9_000.0 - i) for i in range(600)] + [(i, i, "m", 1.0 + (i - 600) / 1000, 8_000.0 + i) for i in range(600, 1200)]
    listings = spark.createDataFrame(rows, "id long, found_at long, model string, km double, price double")
    assert market.km_models(listings, "model", "km", "price", latest=500).count() == 0
    (fitted,) = market.km_models(listings.unionAll(listings.filter("id < 600")), "model", "km", "price").collect()
    assert fitted.n == 1800


def test_price_bands_divide_equal_prices_by_id(spark):
    rows = [(i, m, float(p), "venduto_rimosso", f"2024-01-{1 + i % 9:02d}", f"2024-02-{1 + i % 20:02d}") for m, prices in (("a", [5] * 10), ("b", [1, 2, 2, 2, 2, 2, 9, 9]), ("c", [3, 4])) for i, p in enumerate(prices)]
    sales = spark.createDataFrame(rows, "id int, model string, price double, status string, f string, s string").withColumns({"found_at": F.col("f").cast("timestamp"), "sold_at": F.col("s").cast("timestamp")})
    wanted = set()
    for m in ("a", "b"):
        ordered = sorted((r for r in sales.collect() if r.model == m), key=lambda r: (r.price, r.id))
        n = len(ordered)
        for band, part in enumerate((ordered[: n // 3], ordered[n // 3 : n * 2 // 3], ordered[n * 2 // 3 :]), 1):
            days = sum((r.sold_at - r.found_at).days for r in part) / len(part)
            wanted.add((m, band, min(r.price for r in part), max(r.price for r in part), round(days, 6), len(part)))
    got = {(r.model, r.band, r.min_price, r.max_price, round(r.avg_days, 6), r.n) for r in market.price_bands(sales).collect()}
    assert got == wanted


def test_transitions_across_hours(spark):
    statuses = ["ok", "down", "down", None, "down", "ok", "ok", "down", "degraded"]
    hours = ["01:00", "01:59", "02:00", "02:30", "05:00", "05:00", "09:10", "09:20", "11:00"]
    rows = [(i, c, s, f"2024-01-01 {h}:00") for i, (s, h) in enumerate(zip(statuses, hours)) for c in ("x", None)]
    runs = spark.createDataFrame(rows, "id int, category string, status string, t string").withColumn("ran_at", F.col("t").cast("timestamp"))
    got = sorted((r.category or "", r.id, r.transition) for r in history.health_transitions(runs).collect())
    assert got == [(c, *t) for c in ("", "x") for t in ((1, "went_down"), (4, "went_down"), (5, "recovered"), (7, "went_down"), (8, "recovered"))]


def test_a_large_market_is_not_shuffled_for_its_small_sides(spark):
    """With a market above the limit for broadcasts and sides below it, rows are dealt by order, listing and seller, and never by variant or model."""
    import re

    from __spark_entry__ import queries

    conf = {"spark.sql.autoBroadcastJoinThreshold": "100000", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        plan = queries()["enriched_listings"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(dealt) == ["id"] * 3 + ["listing_id"] + ["seller_id"] * 2  # rows and changes meet once, sellers' drops and profiles are counted and met once
