"""Jobs over a market's tables: what they find, and that a second run changes nothing."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymart.operators import analysis, backfill, deals, depreciation, fleet, merging, nightly
from tallymart.sources import batches, paged
from tallymart.sources.ads import ads_of_scan

# Depreciation


def pools_of(spark, prices):
    rows = [(v, float(p), 1) for v, ps in prices.items() for p in ps]
    return spark.createDataFrame(rows, "variant_key string, price double, n long")


def points_of(spark, prices, today="2026-09-01"):
    return depreciation.points(pools_of(spark, prices), F.lit(today).cast("date"))


def test_variants_are_parsed(spark):
    cases = {"iphone-15-pro-max-256": (15, "pro-max", 256), "iphone-16e-128": (16, "e", 128), "iphone-13-na": (13, "", None), "iphone-13-mini-64": (13, "mini", 64), "iphone-x-64": None, "bmw-123d": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", depreciation.parsed_variant(F.col("v")).alias("p")).collect()
    assert {r.v: r.p and tuple(r.p) for r in rows} == cases


def test_releases_labels_and_names(spark):
    one = spark.range(1).select(
        depreciation.released(F.lit(15), F.lit("pro")).cast("string").alias("a"), depreciation.released(F.lit(16), F.lit("e")).cast("string").alias("b"), depreciation.storage_label(F.lit(1024)).alias("c"), depreciation.storage_label(F.lit(None).cast("int")).alias("d"),
        depreciation.storage_label(F.lit(None).cast("int"), "memoria n/d").alias("e"), depreciation.model_name(F.lit(14), F.lit("pro-max")).alias("f"), depreciation.model_name(F.lit(17), F.lit("e")).alias("g"), depreciation.model_key(F.lit(14), F.lit("")).alias("h"),
    ).first()
    assert tuple(one) == ("2023-09-01", "2025-02-01", "1TB", "tutte", "memoria n/d", "iPhone 14 Pro Max", "iPhone 17e", "iphone-14")


def test_losses_by_storage_and_over_all_storages(spark):
    prices = {
        "iphone-15-pro-256": [900, 900, 900], "iphone-14-pro-256": [600, 600, 600], "iphone-11-pro-256": [300, 300, 300], "iphone-15-pro-128": [800, 800, 800], "iphone-14-pro-na": [500, 500, 500],
        "iphone-16e-128": [500] * 3, "iphone-17e-128": [650] * 3, "iphone-15-128": [700, 700], "iphone-12-air-64": [100] * 3, "iphone-17-air-64": [900] * 3,
    }
    found = {(r.line, r.storage, r.number): r for r in points_of(spark, prices).collect()}
    assert (found["pro", 256, 15].loss_year_eur, found["pro", 256, 15].loss_year_pct, found["pro", 256, 15].loss_month_eur, found["pro", 256, 15].vs_model) == (300, 33.3, 25, "iPhone 14 Pro")
    assert (found["pro", 256, 14].loss_year_eur, found["pro", 256, 14].retention_pct, found["pro", 256, 11].loss_year_eur) == (100, 66.7, None)
    assert ("pro", 128, 15) not in found and ("", 128, 15) not in found  # one generation, too few prices
    assert (found["pro", None, 15].median, found["pro", None, 15].sample, found["pro", None, 14].median, found["pro", None, 14].variant_key) == (850, 6, 550, None)
    assert (found["e", 128, 17].released_at.isoformat(), found["e", 128, 17].loss_year_eur) == ("2026-02-01", 150)
    assert found["air", 64, 17].loss_year_eur is None and found["air", 64, 17].vs_model is None  # five years apart
    assert {tuple(r) for r in depreciation.carry_costs(points_of(spark, prices)).collect()} == {("iphone-15-pro-256", 25), ("iphone-14-pro-256", 8), ("iphone-17e-128", 12)}
    row = depreciation.summary(points_of(spark, prices)).first()
    assert (row.best_model, row.best_loss_year_pct, row.worst_model, row.worst_loss_year_pct, row.mean_loss_pct) == ("iPhone 14 Pro", 16.7, "iPhone 15 Pro", 33.3, 24.4)
    assert [r.model for r in depreciation.ordered_models(points_of(spark, prices)).collect()][:3] == ["iPhone 15 Pro", "iPhone 17e", "iPhone 14 Pro"]
    assert [(r.line, r.storage, r.number) for r in depreciation.ordered_series(points_of(spark, prices)).collect()][:2] == [("air", None, 17), ("air", None, 12)]


def test_depreciation_without_prices(spark):
    none = points_of(spark, {"iphone-x": [1]})
    assert none.count() == 0 and depreciation.carry_costs(none).count() == 0
    assert depreciation.summary(none).first().rated == 0


# Deals


def test_every_deal_keeps_its_own_cost(spark):
    at = datetime(2026, 1, 1)
    rows = [(1, 10, "smartphone", "in_vendita", at), (2, 10, "smartphone", "acquistato", at), (3, 11, "automobile", "acquistato", at), (4, None, "smartphone", "acquistato", at), (5, 99, "smartphone", "venduto", at)]
    owned = spark.createDataFrame([(*r, 100.0, [("x", 5.0)], 150.0, 140.0, at) for r in rows], "id int, listing_id int, category string, stage string, updated_at timestamp, buy_price double, extra_costs array<struct<label: string, amount: double>>, sell_price double, market_avg double, created_at timestamp")
    listings = spark.createDataFrame([(10, "iphone-15-256"), (11, "iphone-15-256"), (12, "iphone-14-64")], "id int, variant_key string")
    carry = spark.createDataFrame([("iphone-15-256", 30)], "variant_key string, carry_month long")
    now = F.lit("2026-01-31").cast("timestamp")
    got = {r.id: (r.variant_key, r.carry_month, r.accrued_loss) for r in deals.deal_list(owned, listings, carry, now).collect()}
    assert got == {1: ("iphone-15-256", 30, 30.0), 2: ("iphone-15-256", 30, 30.0), 3: ("iphone-15-256", None, None), 4: (None, None, None), 5: (None, None, None)}
    assert [r.id for r in deals.deal_list(owned, listings, carry, now, ("acquistato",), 2).collect()] == [2, 3]
    assert deals.summary(owned, listings, carry, now).first().deals == 5
    assert {r.id: r.in_pipeline for r in deals.in_pipeline(listings, owned).collect()} == {10: True, 11: True, 12: False}


# Analysis

REPLIES = [
    (1, "smartphone", '{"motivo_prezzo": "ok", "categoria_motivo": " Difetto", "riparabile": "sì", "rischio_truffa": "ALTO", "storage_gb": "256GB", "battery_pct": 91.6, "color": "Blu Sierra", "extra": [1]}'),
    (2, "smartphone", '{"categoria_motivo": 3, "riparabile": "no", "rischio_truffa": null, "storage_gb": 1, "battery_pct": "0", "color": "null"}'),
    (3, "automobile", '{"riparabile": 1, "storage_gb": 256, "sintesi": null}'),
    (4, "smartphone", "[1]"), (5, "smartphone", "{oops"), (6, "smartphone", None), (7, "smartphone", '"text"'),
    (8, "smartphone", json.dumps({"motivo_prezzo": "x" * 400, "storage_gb": True, "battery_pct": "circa 85%", "riparabile": [], "color": "mezzanotte"})),
]


def parsed_replies(spark):
    return analysis.parse_replies(spark.createDataFrame(REPLIES, "id int, category string, reply string"))


def test_replies_of_all_kinds(spark):
    good, bad = parsed_replies(spark)
    got = {r.id: r for r in good.collect()}
    assert sorted(got) == [1, 2, 3, 8] and sorted(r.id for r in bad.collect()) == [4, 5, 6, 7] and bad.columns == ["id", "category", "reply"]
    a = got[1].analysis
    assert (a.motivo_prezzo, a.categoria_motivo, a.riparabile, a.rischio_truffa, a.sintesi) == ("ok", "difetto", True, "alto", "")
    assert tuple(got[1].fields) == (256, "Blu", 91) and tuple(got[2].fields) == (1024, None, None) and got[3].fields is None
    assert (got[2].analysis.categoria_motivo, got[2].analysis.riparabile, got[2].analysis.rischio_truffa) == ("nessuno", False, "basso")
    assert got[3].analysis.riparabile and len(got[8].analysis.motivo_prezzo) == 300 and not got[8].analysis.riparabile
    assert tuple(got[8].fields) == (None, "Nero", 85)


def test_only_what_is_missing_is_filled_and_only_once(spark):
    good, _ = parsed_replies(spark)
    kind = dict(good.dtypes)["analysis"]
    rows = [(1, "iPhone 15 Pro", "d", "nuovo", None, "", None, "iphone-15-pro-na"), (2, "iPhone 14", "d", "nuovo", 128, "Rosso", 80, "iphone-14-128"), (8, "iPhone 13", "d", "visto", 64, None, None, "iphone-13-64"), (9, "iPhone 12", None, "nuovo", None, None, None, "iphone-12-na")]
    stored = spark.createDataFrame(rows, "id int, title string, description string, status string, storage_gb int, color string, battery_pct int, variant_key string").withColumn("analysis", F.lit(None).cast(kind))
    assert [r.id for r in analysis.backlog(stored, 2).collect()] == [1, 2]
    changed = analysis.fill_missing(analysis.backlog(stored), good)
    got = {r.id: (r.storage_gb, r.color, r.battery_pct, r.variant_key, r.filled) for r in changed.collect()}
    assert got == {1: (256, "Blu", 91, "iphone-15-pro-256", 3), 2: (128, "Rosso", 80, "iphone-14-128", 0), 8: (64, "Nero", 85, "iphone-13-64", 2)}
    after = stored.join(changed.select("id"), "id", "left_anti").select(*stored.columns).unionByName(changed.drop("filled"))
    assert analysis.fill_missing(after, good).count() == 0 and analysis.backlog(after).count() == 0


# Fleet


def test_fleet_sync_settles(spark):
    stored = spark.createDataFrame([("a", "smartphone", "iPhone 15 Pro", '{"min_year": 1}', True, "n1"), ("b", "smartphone", "iPhone 4", "{}", True, "n2"), ("c", "smartphone", "iPhone 3", "{}", False, "n3"), ("d", "automobile", "BMW 123d", "{}", True, "n4")], f"id string, {fleet.TARGET}, note string")
    changes = fleet.fleet_changes(stored, fleet.wanted_fleet(spark))
    by = {r["query"]: r for r in changes.collect()}
    assert {q: by[q].change for q in ("iPhone 15 Pro", "iPhone 4", "iPhone 3", "BMW 123d", "iPhone 17e", "iPhone 13 mini")} == {"iPhone 15 Pro": "update", "iPhone 4": "deactivate", "iPhone 3": "keep", "BMW 123d": "keep", "iPhone 17e": "insert", "iPhone 13 mini": "insert"}
    assert by["iPhone 15 Pro"].id == "a" and by["iPhone 15 Pro"].note == "n1" and not by["iPhone 4"].is_active and "iPhone 12" not in by
    again = fleet.fleet_changes(changes.drop("change"), fleet.wanted_fleet(spark))
    assert {r.change for r in again.collect()} == {"keep"} and again.count() == changes.count()
    assert fleet.active_fleet(changes, "automobile").count() == 2


def test_a_pilot_seed_switches_nothing_off(spark):
    stored = spark.createDataFrame([("a", "smartphone", "iPhone 4", "{}", True), ("b", "smartphone", "iPhone 3", "{}", False), ("c", "smartphone", "iPhone 14", "{}", False)], f"id string, {fleet.TARGET}")
    got = {r["query"]: (r.change, r.is_active) for r in fleet.fleet_changes(stored, fleet.pilot_fleet(spark), switch_off=False).collect()}
    assert got == {"iPhone 4": ("keep", True), "iPhone 3": ("keep", False), "iPhone 14": ("update", True), "Golf GTI": ("insert", True)}


def test_phones_of_a_generation_on(spark):
    every = [r["query"] for r in fleet.phone_targets(fleet.specifications(spark)).orderBy("place", "nth").collect()]
    assert len(every) == len(set(every)) == 36 and every[:3] == ["iPhone 11", "iPhone 11 Pro", "iPhone 11 Pro Max"]
    assert fleet.phone_targets(fleet.specifications(spark), 17).count() == 5


def test_brands_and_products(spark):
    asked = spark.createDataFrame([("iPhone 13", "smartphone"), ("iPhone 13", "smartphone"), ("bmw 123d", "automobile"), ("  ", "automobile")], "model string, category string")
    stored = spark.createDataFrame([("p1", "iPhone 13", "smartphone")], "id string, model string, category string")
    new, every = fleet.products_for(stored, asked)
    assert {(r.model, r.brand) for r in new.collect()} == {("bmw 123d", "Bmw"), ("  ", "Unknown")} and every.count() == 3
    assert {r.product_id for r in every.collect() if r.model == "iPhone 13"} == {"p1"}
    assert fleet.products_for(stored.unionByName(new.drop("brand")), asked)[0].count() == 0


# Merging


def sides(spark):
    target, listing, event = "id string, category string, query string", "id string, listing_url string, target_id string, price double", "id int, listing_id string, new_price double"
    ours = {"targets": [("o1", "s", "A"), ("o2", "s", "B")], "listings": [("l1", "u1", "o1", 1.0), ("t9", "u9", "o1", 1.0)], "history": [(1, "l1", 1.0)]}
    theirs = {"targets": [("t1", "s", "A"), ("t3", "s", "C")], "listings": [("t1", "u1", "t1", 5.0), ("t2", "u2", "t1", 6.0), ("t3", "u3", "t3", 7.0), ("t4", "u4", "gone", 8.0), ("t5", "u5", None, 9.0), ("t9", "u8", "t1", 9.0), ("t6", "u2", "t1", 6.5)], "history": [(1, "t2", 1.0), (2, "t2", 2.0), (3, "t1", 3.0), (4, "t3", 4.0), (4, "t3", 4.0), (5, "t4", 5.0)]}
    make = lambda d: {"targets": spark.createDataFrame(d["targets"], target), "listings": spark.createDataFrame(d["listings"], listing), "history": spark.createDataFrame(d["history"], event)}
    return make(ours), make(theirs)


def test_a_merge_adds_once_and_all_tables_together(spark, tmp_path):
    ours, theirs = sides(spark)
    merge = merging.plan_merge(ours, theirs)
    assert [tuple(r) for r in merge.added["targets"].collect()] == [("t3", "s", "C")]
    assert sorted((r.id, r.listing_url, r.target_id) for r in merge.added["listings"].collect()) == [("t2", "u2", "o1"), ("t3", "u3", "t3"), ("t5", "u5", None)]
    assert sorted(r.id for r in merge.added["history"].collect()) == [2, 4]
    assert sorted((r.id, r.reason) for r in merge.left_out.collect()) == [("t4", "unknown target"), ("t9", "id in use")]
    assert {r["table"]: (r.candidates, r.added) for r in merge.counts().collect()} == {"targets": (2, 1), "listings": (5, 3), "history": (6, 2)}
    folder = f"file://{tmp_path}/ours"
    batches.publish(spark, folder, "0", ours)
    kinds = {t: ours[t].schema for t in merging.TABLES}
    read = lambda: {t: batches.published(spark, folder, t, kinds[t]).drop("batch") for t in merging.TABLES}
    merging.plan_merge(read(), theirs).publish(spark, folder, "1")
    sizes = {t: df.count() for t, df in read().items()}
    assert sizes == {"targets": 3, "listings": 5, "history": 3}
    assert {r.added for r in merging.plan_merge(read(), theirs).counts().collect()} == {0}
    merging.plan_merge(read(), theirs).publish(spark, folder, "1")  # tried again
    assert {t: df.count() for t, df in read().items()} == sizes


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/t", spark.createDataFrame([(1,)], "a int")
    assert batches.published(spark, folder, "x", "a int").count() == 0
    batches.publish(spark, folder, "1", {"x": rows})
    rows.write.parquet(f"{folder}/x/batch=2")  # written, not published
    assert [r.batch for r in batches.published(spark, folder, "x", "a int").collect()] == ["1"]
    batches.publish(spark, folder, "2", {"x": rows.unionAll(rows)})
    assert sorted(r.batch for r in batches.published(spark, folder, "x", "a int").collect()) == ["1", "2", "2"]


# Nightly


def ad(i, title, price, body="", year=None):
    features = [{"uri": "/price", "values": [{"key": str(price), "value": f"{price} €"}]}] + ([{"uri": "/year", "values": [{"key": str(year), "value": str(year)}]}] if year else [])
    return {"subject": title, "body": body, "urls": {"default": f"https://m.example/x/a-{i}.htm"}, "features": features, "date": f"2026-01-{i % 28 + 1:02d} 10:00:00"}


def page(*ads):
    return json.dumps({"ads": list(ads), "count_all": len(ads)})


def test_one_bad_target_leaves_the_others_alone(spark):
    targets = spark.createDataFrame([("a", "smartphone", "iPhone 13", "{}", True), ("b", "smartphone", "iPhone 14", "{bad", True), ("c", "automobile", "BMW 123d", '{"min_year": 2008}', True), ("d", "smartphone", "iPhone 15", None, True), ("e", "smartphone", "iPhone 12", "{}", False), ("f", "smartphone", "iPhone 11", "{}", True)], f"id string, {fleet.TARGET}")
    rows = [
        ("a", 0, page(ad(1, "iPhone 13 nero", 400), ad(2, "cover iPhone 13", 20), ad(3, "iPhone 12", 300), ad(4, "iPhone 13 rotto", 100, "schermo rotto"))), ("a", 50, page(ad(1, "iPhone 13 nero", 390), ad(5, "apple iphone 13", 500), ad(6, "iPhone 13", 450))),
        ("b", 0, page(ad(7, "iPhone 14", 400))), ("c", 0, page(ad(8, "BMW 123d", 9000, year=2010), ad(9, "BMW 123d", 8000, year=2005), ad(10, "altra", 7000, year=2012))), ("d", 0, '{"ads": [{"subject"'), ("d", 50, page(ad(11, "iPhone 15", 700))), ("e", 0, page(ad(12, "iPhone 12", 300))),
    ]
    pages = spark.createDataFrame(rows, "target_id string, start int, page string")
    products = spark.createDataFrame([("p", "iPhone 13", "smartphone")], "id string, model string, category string")
    day = F.lit("2026-02-01").cast("date")
    night = nightly.run_night(targets, pages, products, day)
    got = {r.target_id: (r.scraped, r.considered, r.excluded, r.avg_price, r.volume, r.error) for r in night.results.collect()}
    assert got == {"a": (4, 3, 1, 450.0, 3, None), "b": (None, None, None, None, None, "filters"), "c": (2, 2, 0, 8000.0, 2, None), "d": (None, None, None, None, None, "page"), "f": (0, 0, 0, None, None, None)}
    assert {(r.target_id, r.input, r.start) for r in night.quarantine.collect()} == {("b", "filters", None), ("d", "page", 0)}
    assert {r.model for r in night.new_products.collect()} == {"BMW 123d", "iPhone 11"}
    before = spark.createDataFrame([("b", "x", 111.0), ("a", "x", 222.0)], "target_id string, product_id string, avg_price double").withColumns({"trend_date": day, "min_price": F.lit(1.0), "max_price": F.lit(1.0), "volume": F.lit(1).cast("long")})
    after = {r.target_id: r.avg_price for r in nightly.with_night(before, night).collect()}
    assert after == {"a": 450.0, "b": 111.0, "c": 8000.0}
    without = nightly.run_night(targets.filter("id NOT IN ('b', 'd')"), pages, products, day)
    assert {r.target_id: r.avg_price for r in without.snapshots.collect()} == {r.target_id: r.avg_price for r in night.snapshots.collect()}


def test_later_pages_are_looked_at_only_for_targets_that_are_not_full(spark, monkeypatch):
    """The first ads of each target, whether they fill it early (a), late (b, by its wish) or never (c)."""
    targets = spark.createDataFrame([("a", "smartphone", "iPhone 13", "{}", True), ("b", "automobile", "BMW", '{"max_year": 2003}', True), ("c", "smartphone", "iPhone 14", "{}", True)], f"id string, {fleet.TARGET}")
    rows = [("a", 50 * p, page(*[ad(10 * p + i // 2, "iPhone 13", 400 + 10 * p + i // 2) for i in range(6)])) for p in range(8)]
    rows += [("b", 50 * p, page(*[ad(500 + 10 * p + i, "BMW", 5000 + 10 * p + i, year=2008 - p) for i in range(3)])) for p in range(8)]
    rows += [("c", 0, page(ad(900, "iPhone 14", 600, "schermo rotto"), ad(901, "iPhone 14", 610)))]
    pages = spark.createDataFrame(rows, "target_id string, start int, page string")
    products = spark.createDataFrame([], "id string, model string, category string")
    seen, plain = [], nightly._taken

    def looked(some, *args):
        seen.append(some.filter("target_id = 'a'").count())
        return plain(some, *args)

    monkeypatch.setattr(nightly, "_taken", looked)
    monkeypatch.setattr(nightly, "PAGES_AHEAD", 2)
    day = F.lit("2026-01-01").cast("date")
    got = {r.target_id: (r.scraped, r.excluded, r.min_price, r.max_price, r.volume) for r in nightly.run_night(targets, pages, products, day, most=5).results.collect()}
    assert got == {"a": (5, 0, 400.0, 411.0, 5), "b": (5, 0, 5050.0, 5061.0, 5), "c": (2, 1, 610.0, 610.0, 1)}
    assert seen == [2, 0]


# Paged source and backfills


@pytest.fixture
def landing(tmp_path):
    def land(round_, target, start, ads, total=None, whole=True):
        folder = tmp_path / "landing" / f"round={round_}" / f"target={target}" / f"start={start}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(json.dumps({"ads": ads, "count_all": total}))
        if whole:
            (tmp_path / "landing" / f"round={round_}" / "_SUCCESS").touch()

    land.path = str(tmp_path / "landing")
    return land


def test_pages_with_quota_depth_and_pushed_filters(spark, landing):
    landing("1", "iPhone%2013", 0, [ad(i, f"iPhone {i}", 100 + i) for i in range(5)] + [{"subject": "no url"}], 12)
    landing("1", "iPhone%2013", 50, [ad(i, f"iPhone {i}", 100 + i) for i in range(5, 10)], 60)
    landing("1", "iPhone%2013", 100, [ad(99, "beyond", 100)], 60)
    landing("1", "b", 0, [], 0)
    landing("1", "c", 0, [ad(20, "  Titled ", 50), {**ad(21, "no price", 1), "features": []}], None)
    every = paged.scan(spark, landing.path).collect()
    assert sorted(r.url[-8:] for r in every if r.target == "iPhone 13") == [f"/a-{i}.htm" for i in range(10)]
    assert {(r.title, r.price) for r in every if r.target == "c"} == {("Titled", 50.0), ("no price", None)}
    quota = paged.scan(spark, landing.path, quota=7, min_price=102)
    assert sorted(r.price for r in quota.collect()) == [float(p) for p in range(102, 109)]
    assert quota.filter("price >= 105").count() == 4  # asked of what the quota admitted
    assert {r.start for r in paged.scan(spark, landing.path, max_pages=1).collect()} == {0}
    pushed = paged.scan(spark, landing.path).filter((F.col("target") == "iPhone 13") & (F.col("price") > 103.0) & (F.col("start") < 50))
    plan = pushed._jdf.queryExecution().explainString(pushed.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [" in plan and "GreaterThan(price,103.0)" in plan and "EqualTo(target,iPhone 13)" in plan
    assert sorted(r.price for r in pushed.collect()) == [104.0]
    parsed = ads_of_scan(paged.scan(spark, landing.path).filter("target = 'c'"), "target").orderBy("title").collect()
    assert [(r.target, r.title.strip(), r.price, r.seller_type) for r in parsed] == [("c", "Titled", 50.0, "privato"), ("c", "no price", None, "privato")]
    assert paged.scan(spark, landing.path + "/none").count() == 0


def test_packs_of_pages_read_like_pages(spark, landing, tmp_path):
    """The same pages as a file each and as packs: whole, by depth, by quota, by start, and as a stream."""
    pages = {"a": [[ad(100 * p + i, f"iPhone {i}", 100 + 10 * p + i) for i in range(4)] for p in range(5)], "b": [[ad(900, "x", 120)], []]}
    for target, own in pages.items():
        for p, ads in enumerate(own):
            landing("1", target, 50 * p, ads)
        for first in range(0, len(own), 2):
            pack = own[first : first + 2]
            folder = tmp_path / "packs" / "round=1" / f"target={target}" / f"start={50 * first}" / f"last={50 * (first + len(pack) - 1)}" / f"pages={len(pack)}"
            folder.mkdir(parents=True)
            (folder / "part-0.txt").write_text("\n".join(json.dumps({"start": 50 * (first + n), "ads": ads}) for n, ads in enumerate(pack)))
    (tmp_path / "packs" / "round=1" / "_SUCCESS").touch()
    packs, key = str(tmp_path / "packs"), lambda r: (r.target, r.start, r.place)
    both = lambda ask: [sorted(ask(path).collect(), key=key) for path in (landing.path, packs)]
    start = F.col("start")
    asked = [lambda path, o=o: paged.scan(spark, path, **o) for o in ({}, {"max_pages": 1}, {"max_pages": 3}, {"max_pages": 3, "pages_per_task": 1}, {"quota": 7, "min_price": 103, "max_price": 141}, {"quota": 50, "max_pages": 3})]
    asked += [lambda path, t=t: paged.scan(spark, path).filter(t) for t in (start == 50, start > 100, start >= 100, start < 150, start <= 150, start.isin(0, 150), (start > 50) & (F.col("price") < 133))]
    for ask in asked:
        one, packed = both(ask)
        assert one and one == packed
    for path in (landing.path, packs):
        assert paged.scan(spark, path, max_pages=2).filter(start >= 100).count() == 0  # depth goes before filters
    paged.scan(spark, packs, stream=True).select("url").writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("url string").parquet(f"{tmp_path}/o").count() == 21


def test_a_landed_round_has_fewer_files_than_pages(spark, tmp_path, monkeypatch):
    """Files are committed one by one, so pages must not be a file each; a pack says how many it holds."""
    from tallymart.plans import adapter

    monkeypatch.setattr(adapter, "PAGE_SIZE", 2)
    monkeypatch.setattr(adapter, "PAGES_A_PACK", 3)
    monkeypatch.setattr(adapter, "_LANDED", {})
    d = "/root/testdata/sf0.001"
    found = paged.landed(adapter.landing(spark, d))
    texts = {p: open(p.path).read().splitlines() for p in found}
    assert all(p.count == len(lines) <= 3 and [p.start, p.last] == [json.loads(lines[n])["start"] for n in (0, -1)] for p, lines in texts.items())
    pages = adapter.pages(spark, d).select("target_id", "start").collect()
    assert sorted((p.target, json.loads(line)["start"]) for p, lines in texts.items() for line in lines) == sorted(map(tuple, pages)) and len(found) < len(pages)


def test_a_landed_backfill_takes_every_page_of_a_target(spark, tmp_path):
    """More pages than a pack holds, in the query and in its SQL."""
    import duckdb

    from tallymart.plans import jobs

    n, d = 10_120, f"{tmp_path}/one"
    key = F.col("id")
    orders = spark.range(n).select(key.alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), (key % 100 * 5000 + 0.5).alias("o_totalprice"), F.timestamp_seconds(F.lit(756_518_400) + key % 3000 * 86_400).cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    customer = spark.range(1).selectExpr("1L AS c_custkey", "1 AS c_nationkey", "'BUILDING' AS c_mktsegment")
    for name, rows in (("orders", orders), ("customer", customer)):
        rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    got = sorted((r.target, r.start, r.place, r.url, r.price, r.published.isoformat()) for r in jobs.landed_backfill(spark, d).withColumn("published", F.col("published").cast("timestamp_ntz")).collect())
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    sql = sorted((*r[:5], r[5].isoformat()) for r in db.execute(jobs.ORACLES["landed_backfill"]).fetchall())
    wanted = orders.filter("floor(o_totalprice) >= 20000 AND floor(o_totalprice) < 300000 AND o_orderdate >= TIMESTAMP_NTZ '1994-01-01'").count()
    assert len(got) == wanted and max(r[1] for r in got) >= 10_000
    assert got == sql


def test_rounds_stream_as_they_are_complete(spark, landing, tmp_path):
    def drain():
        paged.scan(spark, landing.path, stream=True).select("round", "url").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["round"], r.url[-8:]) for r in spark.read.schema("round string, url string").parquet(f"{tmp_path}/out").collect())

    landing("1", "a", 0, [ad(1, "x", 10)])
    landing("2", "a", 0, [ad(2, "x", 10)], whole=False)
    assert drain() == [("1", "/a-1.htm")]
    os.close(os.open(f"{landing.path}/round=2/_SUCCESS", os.O_CREAT))
    landing("3", "b", 0, [ad(3, "x", 10)])
    assert drain() == [("1", "/a-1.htm"), ("2", "/a-2.htm"), ("3", "/a-3.htm")]
    assert len(drain()) == 3


def test_backfill_totals_and_fleet(spark):
    found = spark.createDataFrame([("a", "u1", 10.0), ("a", "u1", 9.0), ("a", "u2", 10.0), ("a", "u3", 50.0), ("b", "u4", 1.0)], "target string, listing_url string, price double")
    stored = spark.createDataFrame([("u1", 9.5), ("u3", 40.0)], "listing_url string, price double")
    assert {tuple(r) for r in backfill.backfill_totals(found, stored).collect()} == {("a", 4, 1, 2, 1), ("b", 1, 1, 0, 0)}
    targets = spark.createDataFrame([("1", "smartphone", "iPhone 13", "{}", True), ("2", "smartphone", "iPhone 14", "{}", False), ("3", "automobile", "BMW", "{}", True)], f"id string, {fleet.TARGET}")
    assert [r.id for r in backfill.backfill_fleet(targets, "smartphone", "PHONE").collect()] == ["1"]


def test_variants_are_rewritten_only_where_they_changed(spark, tmp_path):
    path = f"{tmp_path}/listings"
    rows = [(1, "iPhone 13 128 GB blu", "smartphone", None, 128, "iphone-old", "buono", None, "p1"), (2, "iPhone 14", "smartphone", None, None, "iphone-14-na", "buono", "Rosso", "p1"), (3, "iPhone 15", "smartphone", None, 256, "iphone-15-256", "buono", None, "p2"), (4, "BMW", "automobile", "t", None, "bmw-123d-2008-", "buono", None, "p3")]
    kind = "id int, title string, category string, target_id string, storage_gb int, variant_key string, tier string, color string, part string"
    none = F.array().cast("array<string>")
    spark.createDataFrame(rows, kind).withColumns({"defects_noted": none, "features": none}).repartition("part").write.partitionBy("part").parquet(path)
    targets = spark.createDataFrame([("t", "automobile", "BMW 123d", '{"min_year": 2008}', True)], f"id string, {fleet.TARGET}")
    files = lambda: {f"{p}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for p in [os.path.basename(d)] for n in names if n.endswith(".parquet")}
    before = files()
    fix = backfill.variant_changes(spark.read.parquet(path), targets).collect()
    assert [(r.id, r.variant_key, r.color) for r in fix if r.id == 1] == [(1, "iphone-13-128", "Blu")]
    n = backfill.backfill_variants(spark, path, targets, "part")
    after = files()
    assert n == len(fix) and {k for k in before if k in after} == {k for k in before if k.startswith(("part=p2", "part=p3") if n == 1 else "part=p2")}
    got = {r.id: (r.variant_key, r.color) for r in spark.read.parquet(path).collect()}
    assert len(got) == 4 and got[1] == ("iphone-13-128", "Blu") and got[2] == ("iphone-14-na", "Rosso") and got[3] == ("iphone-15-256", None)
    assert backfill.backfill_variants(spark, path, targets, "part") == 0 and files() == after


# Engine


def test_engine_shows_targets_costs_and_the_pipeline(spark):
    from tallymart.engine import Engine
    from tallymart.operators import feed

    at = datetime(2026, 1, 1)
    prices = {"iphone-15-pro-256": 900.0, "iphone-14-pro-256": 600.0}
    rows = [(f"{v}/{k}", "s1", v.rsplit("-", 1)[0], v, "smartphone", p + k, "nuovo", "buono", at, None, "t1", f"https://m.example/x/bello-{k}.htm") for v, p in prices.items() for k in range(4)]
    kind = "id string, seller_id string, model string, variant_key string, category string, price double, status string, tier string, found_at timestamp, sold_at timestamp, target_id string, listing_url string"
    owned = spark.createDataFrame([(1, "iphone-15-pro-256/0", "smartphone", "in_vendita", at, 500.0, [("x", 5.0)], 900.0, 900.0, at)], "id int, listing_id string, category string, stage string, updated_at timestamp, buy_price double, extra_costs array<struct<label: string, amount: double>>, sell_price double, market_avg double, created_at timestamp")
    targets = spark.createDataFrame([("t1", "smartphone", "iPhone", "{}", True)], f"id string, {fleet.TARGET}")
    engine = Engine(spark.createDataFrame(rows, kind), F.lit("2026-01-31").cast("timestamp"), deals=owned, targets=targets)
    valued = {r.id: r for r in engine.valued().collect()}
    assert len(valued) == 8 and {r.target_name for r in valued.values()} == {"iPhone"}
    assert [k for k, r in valued.items() if r.in_pipeline] == ["iphone-15-pro-256/0"] and valued["iphone-15-pro-256/0"].carry_month == 25
    assert [(r.number, r.loss_year_eur) for r in engine.depreciation("smartphone").filter("not merged").collect()] == [(15, 300), (14, None)]
    assert engine.depreciation("auto") is None
    assert engine.deal_results().first().accrued_loss == 25.0 and engine.latest_deals(("venduto",)).count() == 0
    view = engine.feed_view(feed.Wanted(category="smartphone"), size=3)
    first = view.first()
    assert view.count() == 3 and first.title.startswith("Bello") and first.foundAt == "2026-01-01T00:00:00+00:00" and first.defects == [] and first.askingPrice >= 600 and "variantKey" in view.columns
