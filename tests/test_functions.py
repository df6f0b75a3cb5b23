"""Column functions against golden values and Python's own definitions."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions import text as T
from tallymart.functions.times import elapsed_days, whole_days
from tallymart.operators import history, listings, pools, valuation
from tallymart.params import DEFAULTS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(values):
    return F.sort_array(F.array(*[F.lit(float(v)) for v in values])) if values else F.array().cast("array<double>")


def test_quantiles_are_the_exclusive_ones(spark):
    random.seed(1)
    for values in ([400, 420, 450, 455, 460, 480, 500, 1000], [1, 2, 3, 10], [5, 7], *[[random.randint(1, 99) for _ in range(random.randint(2, 30))] for _ in range(12)]):
        got = one(spark, *[S.quantile(array(values), i, 4).alias(f"q{i}") for i in (1, 2, 3)], S.quantile(array(values), 1, 10).alias("p"), S.median(array(values)).alias("m"))
        assert list(got[:3]) == pytest.approx(statistics.quantiles(values, n=4)) and got.p == pytest.approx(statistics.quantiles(values, n=10)[0]) and got.m == statistics.median(values)
    assert one(spark, S.quantile(array([3]), 1, 4).alias("q"), S.median(array([])).alias("m")) == (None, None)


def test_pools_of_hot_and_small_keys(spark):
    """Pools against the definitions; repeated prices, prices that are null or not positive, and an empty table."""
    random.seed(2)
    rows = [(f"k{k}", float(random.choice((1, 5, 6, 7, 8, 200, -3, 0)))) for k in range(14) for _ in range(k)] + [("hot", float(random.randint(1, 60))) for _ in range(3000)] + [("k9", None), (None, 4.0)]
    table = spark.createDataFrame(rows, "key string, price double")
    pool = pools.pool_of(table, ["key"])
    cuts = {r.key: r for r in pools.per_pool(pool, ["key"], *[pools.quantile(i, 4).alias(f"q{i}") for i in (1, 2, 3)], pools.quantile(1, 10).alias("p"), pools.median().alias("m")).collect()}
    inside = {r.key: r for r in pools.per_pool(pools.fenced(pool, ["key"]), ["key"], F.min("price").alias("low"), F.max("price").alias("high"), pools.median().alias("m"), pools.mean().alias("mean")).collect()}
    for key in {k for k, _ in rows}:
        positive = sorted(v for k, v in rows if k == key and v is not None and v > 0)
        if not positive:
            assert key not in cuts
            continue
        kept = positive
        if len(positive) >= 2:
            assert [cuts[key][f"q{i}"] for i in (1, 2, 3)] == pytest.approx(statistics.quantiles(positive, n=4)) and cuts[key].p == pytest.approx(statistics.quantiles(positive, n=10)[0])
        if len(positive) >= 4:
            q1, _, q3 = statistics.quantiles(positive, n=4)
            kept = [v for v in positive if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)] if q3 > q1 else positive
        assert cuts[key].m == statistics.median(positive) and cuts[key].n == len(positive)
        assert (inside[key].n, inside[key].low, inside[key].high, inside[key].m) == (len(kept), kept[0], kept[-1], statistics.median(kept)) and inside[key].mean == pytest.approx(statistics.mean(kept))
    assert pools.fenced(pools.pool_of(table.limit(0), ["key"]), ["key"]).count() == 0


def test_phone_and_car_texts(spark):
    rows = [
        ("iPhone 13 Pro 256GB", "batteria 89%, scatola e fattura"), ("iPhone 12 per ricambi", "schermo rotto e icloud bloccato"), ("iPhone 15 1TB", "battery health 100%"),
        ("BMW 320d 2018 150.000 km", "perfetta, mai incidentata"), ("Cover per iPhone 13", None), ("iPhone 13 con cover inclusa", "batteria da cambiare? No, batteria appena sostituita"), (None, None), ("Fiat 150 mila km", ""),
    ]
    found = listings.parse_listings(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, description string")).orderBy("id").collect()
    assert (found[0].storage_gb, found[0].battery_pct, found[0].features) == (256, 89, ["Scatola", "Fattura"])
    assert found[1].defects_noted == ["schermo-rotto", "icloud-bloccato", "per-ricambi"] and found[1].exclude_from_iqr
    assert (found[2].storage_gb, found[2].battery_pct) == (1024, 100)
    assert (found[3].km, found[3].year, found[3].exclude_from_iqr) == (150000, 2018, True)
    assert found[4].is_accessory and not found[5].is_accessory and found[5].defects_noted == [] and "Batteria-Cambiata" in found[5].features
    assert found[6].features == [] and found[6].km is None and found[7].km == 150000


@pytest.mark.parametrize(
    ("title", "storage", "key"),
    [("iPhone 13 128GB", 128, "iphone-13-128"), ("iPhone 14 Pro Max", 256, "iphone-14-pro-max-256"), ("iphone 16e", 128, "iphone-16e-128"), ("iPhone 17 Air", 256, "iphone-17-air-256"), ("iPhone 15 Plus", None, "iphone-15-plus-na"), ("Galaxy S21", 128, "galaxy-s21-128")],
)
def test_variants(spark, title, storage, key):
    none = F.lit(None).cast("int")
    assert one(spark, listings.variant_key(F.lit("smartphone"), F.lit(title), F.lit(storage).cast("int"), F.lit(None).cast("string"), none, none).alias("k")).k == key


def test_car_variants_conditions_and_slugs(spark):
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    car = lambda low, high: listings.variant_key(F.lit("automobile"), text, none, F.lit("BMW 123d"), low, high)
    tier = lambda defects, features=(): listings.condition_tier(F.lit("smartphone"), F.array(*map(F.lit, defects)).cast("array<string>"), F.array(*map(F.lit, features)).cast("array<string>"))
    got = one(spark, car(F.lit(2007), F.lit(2013)), car(none, none), tier(["schermo-rotto"]), tier(["batteria-esausta"]), tier([], ["Pari-al-Nuovo"]), tier([]), T.slug(F.lit("Più Città!")), T.slug(F.lit("--")))
    assert list(got) == ["bmw-123d-2007-2013", "bmw-123d", "rotto", "difetti", "come-nuovo", "buono", "piu-citta", "na"]


def test_deal_classes(spark):
    fair, cls = F.lit(455.0), lambda price, photo=True: valuation.deal_class(F.lit(price), F.lit(455.0), F.lit(photo))
    got = one(spark, cls(350.0), cls(460.0), cls(600.0), cls(150.0, False), cls(280.0, False), valuation.deal_class(F.lit(5.0), F.lit(None).cast("double"), F.lit(True)))
    assert list(got) == ["affare", "in-linea", "caro", "sospetto", "sospetto", "n/d"]
    none = F.lit(None).cast("double")
    value = one(spark, valuation.fair_value(F.lit("automobile"), F.lit("buono"), fair, none, none, F.lit(13000.0)).alias("v")).v
    assert value == 13000.0


def test_offers_penalties_and_repairs(spark):
    defects = F.array(F.lit("graffi"), F.lit("grandine"))
    broken = F.array(F.lit("schermo-rotto"))
    zero = F.lit(0)
    got = one(
        spark, valuation.defect_penalty(F.lit("automobile"), defects), valuation.repair_cost(F.lit("smartphone"), F.lit("iPhone 14 Pro Max"), broken), valuation.suggested_offer(F.lit("smartphone"), F.lit(None).cast("double"), F.lit(300.0), zero, zero),
        valuation.suggested_offer(F.lit("smartphone"), F.lit(650.0), F.lit(300.0), zero, F.lit(380)), valuation.max_bid(F.lit("automobile"), F.lit(10000.0), F.lit(300), zero, F.lit(20)),
    )
    assert list(got) == [1300, 380, None, 150.0, 8150.0]


def test_scores_stay_in_bounds(spark):
    rows = spark.range(200).withColumns({"m": F.rand(1) * 200 - 100, "d": F.col("id") % 9, "b": (F.col("id") % 60 + 45)})
    score = valuation.deal_score(F.lit("smartphone"), F.col("m"), F.lit(12), F.lit("privato"), F.col("d"), F.col("d"), F.col("d"), F.col("b"), F.col("d") > 3)
    assert rows.filter(~score.between(0, 100)).count() == 0
    risk = valuation.risk_score(F.array(F.lit("icloud-bloccato")), F.lit("solo spedizione, pagamento anticipato"), F.lit("sospetto"), F.lit(False), F.lit("finto_privato"), F.lit(0))
    got = one(spark, risk.alias("r"), valuation.risk_level(risk).alias("l"))
    assert got == (100, "alto")
    assert one(spark, valuation.risk_score(F.array().cast("array<string>"), F.lit("a mano"), F.lit("affare"), F.lit(False), F.lit("privato"), F.lit(3)).alias("r")).r is None


def test_run_status_truth_table(spark):
    cases = {(17, 17, 0, 300): "ok", (17, 15, 2, 280): "degraded", (17, 0, 17, 0): "down", (17, 17, 0, 0): "down", (0, 0, 0, 0): "idle"}
    for case, status in cases.items():
        assert one(spark, history.run_status(*map(F.lit, case)).alias("s")).s == status


def test_depreciation_golden_values(spark):
    rows = [("pro", n, p + k) for n, p in ((16, 900), (15, 600), (14, 450)) for k in (0, 0, 0)] + [("mini", 13, 300)] * 3 + [("plus", 14, 1), ("plus", 15, 2)]
    found = {r.number: r for r in history.depreciation(spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "line string, number int, price double"), F.lit("2026-09-01").cast("date")).collect()}
    assert set(found) == {14, 15, 16}
    assert found[16].loss_year == 300 and found[16].loss_pct == pytest.approx(100 / 3) and found[16].loss_month == 25 and found[16].retention_pct == 100
    assert found[14].loss_year is None and found[14].retention_pct == 50 and found[16].age_years == pytest.approx(2.0, abs=0.01)


def test_time_text_and_money_helpers(spark):
    late, early = F.lit("2024-01-02 01:00:00").cast("timestamp"), F.lit("2024-01-01 23:00:00").cast("timestamp")
    got = one(
        spark, whole_days(early, late).alias("a"), whole_days(late, early).alias("b"), (elapsed_days(early, late) * 24).alias("c"), T.euros(F.lit(1234567.0)).alias("d"), T.whole_price(F.lit("1.250,00 €")).alias("e"),
        T.id_of_url(F.lit("https://x.it/a/iphone-13-998.htm?x=1")).alias("f"), T.title_of_url(F.lit("https://x.it/a/iphone-13-pro-998.htm")).alias("g"), T.holds_all_words(F.lit("iPhone 13 Pro, nuovo"), F.lit("iphone 13 pro")).alias("h"),
    )
    assert list(got) == [0, 0, 2.0, "1.234.567 €", 1250, "998", "Iphone 13 Pro", True]


def test_settings_overlay():
    changed = DEFAULTS.overlaid({"deal_pct": 20.0, "target_margin_pct": {"automobile": 10.0}, "unknown": 1, "alert_min_score": None})
    assert changed.deal_pct == 20.0 and changed.target_margin_pct == {"automobile": 10.0, "smartphone": 18.0} and changed.alert_min_score == 55 and DEFAULTS.deal_pct == 15.0


def test_letters_fold_by_what_they_are_made_of(spark):
    rows = [("Ő ş  ﬁne １２８ĲE\u0301", "o s fine 128ije"), ("Perché\u00a0NON", "perche non"), ("ẞ łø", "ß łø"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, wanted string").select(T.folded(F.col("t")).alias("t"), "wanted").collect()
    assert [r.t for r in got] == [r.wanted for r in got]


def test_folding_finds_joined_letters_without_a_pattern(spark):
    """A pattern over each character of a text took most of the time of folding."""
    plan = spark.range(1).select(T.folded(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan.upper()
    rows = spark.createDataFrame([("ĲS ﬁno ﬃ",), ("Ĳ",), ("ĳ",), ("Perché  NO",), ("",), (None,)], "t string")
    assert [r.v for r in rows.select(T.folded(F.col("t")).alias("v")).collect()] == ["ijs fino ffi", "ij", "ij", "perche no", "", None]
