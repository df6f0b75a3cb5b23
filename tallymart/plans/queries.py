"""Every operator of the analytics as a query over the adapted tables, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import stats as S
from tallymart.functions import text as T
from tallymart.functions.times import whole_days
from tallymart.operators import enrichment, feed, history, incremental, listings, market, valuation
from tallymart.plans import adapter as A
from tallymart.plans import oracles as O
from tallymart.sources import table
from tallymart.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


POOLS = O.fenced(f"(SELECT * FROM listings WHERE {O.HEALTHY})", "variant_key", "pools", 3)
VALUED = f"""medians AS (SELECT variant_key, {O.median("p")} AS mid FROM pools),
factored AS (SELECT l.*, mid * CASE WHEN category = 'automobile' THEN CASE tier WHEN 'difetti' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
  ELSE CASE tier WHEN 'come-nuovo' THEN 1.08::DOUBLE WHEN 'difetti' THEN 0.82::DOUBLE WHEN 'rotto' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END END AS fair_value FROM listings l LEFT JOIN medians USING (variant_key)),
valued AS (SELECT *, fair_value - price AS margin_eur, (fair_value - price) / price * 100 AS margin_pct,
  CASE WHEN fair_value IS NULL THEN 'n/d' WHEN price / fair_value < 0.55::DOUBLE THEN 'sospetto' WHEN (fair_value - price) / price * 100 >= 15 THEN 'affare' WHEN price / fair_value > 1.15::DOUBLE THEN 'caro' ELSE 'in-linea' END AS deal_class FROM factored)"""


def _valued(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d)
    return valuation.value_listings(rows, market.variant_pools(rows))


@query(f"WITH {O.LISTINGS}, {POOLS}, {VALUED} SELECT id, variant_key, price, fair_value, margin_eur, margin_pct, deal_class FROM valued WHERE {O.ACTIVE}")
def fair_value_deal_class(spark: SparkSession, d: str) -> DataFrame:
    return _valued(spark, d).filter(market.is_active(F.col("status"))).select("id", "variant_key", "price", "fair_value", "margin_eur", "margin_pct", "deal_class")


@query(f"WITH {O.LISTINGS}, {POOLS} SELECT variant_key, {O.mean('p')} AS avg_price, p[1] AS min_price, p[len(p)] AS max_price, {O.median('p')} AS median_price, len(p)::BIGINT AS n FROM pools")
def variant_pool_stats(spark: SparkSession, d: str) -> DataFrame:
    return market.pool_stats(market.variant_pools(A.listings(spark, d)))


_SOLD_REFS = O.fenced("(SELECT variant_key, tier, price FROM listings WHERE status = 'venduto_rimosso' UNION ALL SELECT variant_key, '__all__', price FROM listings WHERE status = 'venduto_rimosso')", "variant_key, tier", "refs", 5)


@query(f"WITH {O.LISTINGS}, {_SOLD_REFS} SELECT variant_key, tier, {O.median('p')} AS median_price, len(p)::BIGINT AS n FROM refs")
def sold_refs_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return market.sold_references(A.listings(spark, d))


@query(f"WITH {O.LISTINGS}, {POOLS} SELECT id, variant_key, CASE WHEN p IS NOT NULL THEN len(list_filter(p, lambda v: v < price)) / len(p) END AS position FROM listings LEFT JOIN pools USING (variant_key)")
def price_position(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d)
    return market.price_positions(rows, market.variant_pools(rows)).select("id", "variant_key", "position")


@query("""SELECT p_brand, count(*) AS n, regr_slope(l_extendedprice, l_quantity) < 0 AS falling FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY p_brand HAVING count(*) >= 8 AND regr_slope(l_extendedprice, l_quantity) < 0""")
def km_regression_sign(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select("p_brand", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return market.km_models(rows, "p_brand", "x", "y").select("p_brand", "n", (F.col("slope") < 0).alias("falling"))


_SELLERS = f"""WITH {O.SALES}, dropped AS (SELECT DISTINCT l_orderkey AS id, 1 AS dropped FROM lineitem WHERE l_discount >= 0.09),
counted AS (SELECT seller_id, count(*) FILTER (WHERE status <> 'venduto_rimosso') AS active, count(*) FILTER (WHERE status = 'venduto_rimosso') AS sold, count(*) AS listed, count(dropped) AS dropped,
  sum((epoch_us(sold_at) - epoch_us(found_at)) / 86400000000::DOUBLE) FILTER (WHERE sold_at >= found_at AND sold_at <= found_at + INTERVAL 365 DAYS) / count(*) FILTER (WHERE sold_at >= found_at AND sold_at <= found_at + INTERVAL 365 DAYS) AS avg_days
  FROM sales LEFT JOIN dropped USING (id) GROUP BY seller_id),
profiles AS (SELECT *, dropped / listed * 100 AS drop_rate, coalesce(avg_days <= 14, false) OR dropped / listed * 100 >= 40 AS motivated FROM counted)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    drops = table(spark, d, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("id")).distinct()
    return history.seller_profiles(A.listings(spark, d, sales=True), drops)


@query(f"{_SELLERS} SELECT * FROM profiles")
def seller_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d)


@query(f"{_SELLERS} SELECT * FROM profiles WHERE active + sold >= 2 ORDER BY motivated DESC, active + sold DESC, seller_id LIMIT 25")
def seller_ranking_topk(spark: SparkSession, d: str) -> DataFrame:
    return history.rank_sellers(_profiles(spark, d))


@query(f"""WITH {O.HISTORY}, grouped AS (SELECT listing_id, min({{'a': changed_at, 'b': new_price, 'c': old_price}}) AS f, max({{'a': changed_at, 'b': new_price, 'c': old_price}}) AS l, count(*) FILTER (WHERE new_price < old_price) AS drops FROM history GROUP BY listing_id),
flat AS (SELECT listing_id, f.c AS first_price, l.b AS last_price, drops, greatest(0, floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(l.a)) / 86400000000::DOUBLE))::BIGINT AS days_since FROM grouped)
SELECT *, first_price - last_price AS drop_eur, (first_price - last_price) / first_price * 100 AS drop_pct, CASE WHEN drops >= 2 OR (first_price - last_price) / first_price * 100 >= 10 THEN 'alto' ELSE 'medio' END AS level
FROM flat WHERE drops > 0 AND first_price - last_price > 0""")
def price_watch(spark: SparkSession, d: str) -> DataFrame:
    return history.price_watch(A.history(spark, d), A.as_of())


@query(f"WITH {O.HISTORY} SELECT listing_id, old_price, new_price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY changed_at DESC, new_price DESC, old_price DESC) AS nth FROM history) WHERE nth = 1")
def latest_price_change(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_change(A.history(spark, d)).drop("changed_at")


_SNAPSHOT = O.fenced("(SELECT model, CAST(found_at AS DATE) AS trend_date, price FROM listings)", "model, trend_date", "snap", 1)


@query(f"WITH {O.LISTINGS}, {_SNAPSHOT} SELECT model, strftime(trend_date, '%Y-%m-%d') AS trend_date, {O.mean('p')} AS avg_price, p[1] AS min_price, p[len(p)] AS max_price, len(p)::BIGINT AS volume FROM snap")
def market_snapshot_daily(spark: SparkSession, d: str) -> DataFrame:
    return market.market_snapshot(A.listings(spark, d), "model", F.to_date("found_at")).withColumn("trend_date", F.col("trend_date").cast("string"))


_MONTHLY = O.fenced("(SELECT model, date_trunc('month', found_at)::DATE AS trend_date, price FROM listings)", "model, trend_date", "snap", 1)
_TREND = f"""series AS (SELECT model, trend_date, {O.mean("p")} AS avg_price FROM snap),
trends AS (SELECT model, arg_min(avg_price, trend_date) AS first_avg, arg_max(avg_price, trend_date) AS last_avg, count(*) AS n FROM series GROUP BY model HAVING count(*) >= 2)"""


def _trends(spark: SparkSession, d: str) -> DataFrame:
    return market.trend_changes(market.market_snapshot(A.listings(spark, d), "model", F.trunc("found_at", "month")), "model")


@query(f"WITH {O.LISTINGS}, {_MONTHLY}, {_TREND} SELECT *, (last_avg - first_avg) / first_avg * 100 AS change_pct FROM trends")
def trend_change_pct(spark: SparkSession, d: str) -> DataFrame:
    return _trends(spark, d)


@query(f"WITH {O.LISTINGS}, {_MONTHLY}, series AS (SELECT model, trend_date, {O.mean('p')} AS avg_price FROM snap) SELECT model, arg_max(avg_price, trend_date) AS market_avg FROM series GROUP BY model")
def latest_market_average(spark: SparkSession, d: str) -> DataFrame:
    return market.latest_averages(market.market_snapshot(A.listings(spark, d), "model", F.trunc("found_at", "month")), "model")


_HEALTHY_BOX = f"boxes AS (SELECT model, list_sort(list(price)) AS p FROM listings WHERE {O.ACTIVE} AND {O.HEALTHY} GROUP BY model HAVING count(*) >= 4)"


@query(f"WITH {O.LISTINGS}, {_HEALTHY_BOX} SELECT model, {O.quantile('p', 1, 4)} AS fast_price, {O.quantile('p', 2, 4)} AS full_price, len(p)::BIGINT AS n FROM boxes")
def resale_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return market.resale_suggestions(A.listings(spark, d))


@query(f"""WITH {O.LISTINGS}, {_HEALTHY_BOX}, volumes AS (SELECT model, count(*) AS volume, count(*) FILTER (WHERE found_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAYS) AS inflow, count(DISTINCT seller_id) AS sellers FROM listings WHERE {O.ACTIVE} GROUP BY model),
cut AS (SELECT model, p, p[1] AS low, {O.quantile("p", 1, 4)} AS q1, {O.median("p")} AS mid, {O.quantile("p", 3, 4)} AS q3, p[len(p)] AS high, {O.quantile("p", 1, 10)} AS p10 FROM boxes)
SELECT model, volume, inflow, sellers, low, q1, mid, q3, high, p10, len(list_filter(p, lambda v: v < 0.85::DOUBLE * mid))::BIGINT AS under_market, mid - p10 AS spread, (mid - p10) / mid * 100 AS margin_potential FROM volumes LEFT JOIN cut USING (model)""")
def model_analytics_box(spark: SparkSession, d: str) -> DataFrame:
    return market.model_boxes(A.listings(spark, d), A.as_of())


@query(f"WITH {O.LISTINGS}, g AS (SELECT model, storage_gb, list_sort(list(price)) AS p FROM listings WHERE {O.ACTIVE} AND {O.HEALTHY} GROUP BY 1, 2 HAVING count(*) >= 3) SELECT model, storage_gb, {O.median('p')} AS median_price, len(p)::BIGINT AS n FROM g")
def storage_premium(spark: SparkSession, d: str) -> DataFrame:
    return market.group_medians(A.listings(spark, d), ["model", "storage_gb"], healthy=True)


@query(f"WITH {O.LISTINGS}, g AS (SELECT model, tier, list_sort(list(price)) AS p FROM listings WHERE {O.ACTIVE} GROUP BY 1, 2 HAVING count(*) >= 3) SELECT model, tier, {O.median('p')} AS median_price, len(p)::BIGINT AS n FROM g")
def condition_impact(spark: SparkSession, d: str) -> DataFrame:
    return market.group_medians(A.listings(spark, d), ["model", "tier"], healthy=False)


@query(f"""WITH {O.LISTINGS}, a AS (SELECT * FROM listings WHERE {O.ACTIVE}) SELECT 'model' AS facet, model AS value, count(*) AS n FROM a GROUP BY model UNION ALL SELECT 'storage_gb', storage_gb::VARCHAR, count(*) FROM a GROUP BY storage_gb
UNION ALL SELECT 'color', color, count(*) FROM a GROUP BY color UNION ALL SELECT 'tier', tier, count(*) FROM a GROUP BY tier""")
def facets_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return market.facets(A.listings(spark, d), ["model", "storage_gb", "color", "tier"])


_SOLD = """sold AS (SELECT model, sum(days::DECIMAL(18, 6))::DOUBLE / count(*) AS avg_days, count(*) AS sold, list_sort(list(price)) AS p, max(price) AS max_price, count(*) FILTER (WHERE sold_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAYS) AS outflow FROM facts GROUP BY model HAVING count(*) >= 3)"""
_VOLUMES = f"volumes AS (SELECT model, count(*) AS volume, count(*) FILTER (WHERE found_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAYS) AS inflow FROM listings WHERE {O.ACTIVE} GROUP BY model)"


@query(f"WITH {O.SALES}, {_SOLD} SELECT model, avg_days, sold, {O.median('p')} AS median_price, max_price, outflow FROM sold")
def sold_statistics(spark: SparkSession, d: str) -> DataFrame:
    return market.sold_stats(A.listings(spark, d, sales=True), A.as_of())


@query(f"""WITH {O.SALES}, {_SOLD}, {_VOLUMES}, both_sides AS (SELECT model, coalesce(volume, 0) AS volume, inflow, coalesce(sold, 0) AS sold, avg_days, outflow FROM volumes FULL JOIN sold USING (model)),
parts AS (SELECT *, sold / (sold + volume) * 100 AS sell_through, CASE WHEN inflow > 0 THEN outflow / inflow END AS demand FROM both_sides),
listed AS (SELECT *, list_filter([least(sell_through, 100.0::DOUBLE), least(greatest((30 - avg_days) / 27 * 100, 0.0::DOUBLE), 100.0::DOUBLE), CASE WHEN demand IS NOT NULL THEN least(demand * 50, 100.0::DOUBLE) END], lambda x: x IS NOT NULL) AS l FROM parts),
scored AS (SELECT *, CASE WHEN len(l) > 0 THEN list_reduce(l, lambda a, b: a + b) / len(l) * CASE WHEN volume < 3 THEN 0.6::DOUBLE ELSE 1 END END AS liquidity FROM listed)
SELECT model, volume, inflow, sold, avg_days, outflow, sell_through, demand, liquidity, CASE WHEN liquidity >= 66 THEN 'alta' WHEN liquidity >= 33 THEN 'media' WHEN liquidity IS NOT NULL THEN 'bassa' END AS level FROM scored""")
def liquidity_index(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d, sales=True)
    return market.liquidity(market.model_boxes(rows, A.as_of()), market.sold_stats(rows, A.as_of()))


@query(f"""WITH {O.SALES}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY price, id) AS nth, count(*) OVER (PARTITION BY model) AS n FROM facts)
SELECT model, CASE WHEN nth <= n // 3 THEN 1 WHEN nth <= 2 * n // 3 THEN 2 ELSE 3 END AS band, min(price) AS min_price, max(price) AS max_price, sum(days::DECIMAL(18, 6))::DOUBLE / count(*) AS avg_days, count(*) AS n FROM n WHERE n >= 6 GROUP BY 1, 2""")
def price_bands_thirds(spark: SparkSession, d: str) -> DataFrame:
    return market.price_bands(A.listings(spark, d, sales=True))


_CUBE = f"""cubed AS (SELECT model, color, storage_gb, sum(days::DECIMAL(18, 6))::DOUBLE / count(*) AS avg_days, count(*) AS n, list_sort(list(price)) AS p, grouping(model, color, storage_gb)::BIGINT AS level FROM facts GROUP BY CUBE (model, color, storage_gb))"""


@query(f"WITH {O.SALES}, {_CUBE} SELECT model, color, storage_gb, avg_days, n, {O.median('p')} AS median_price, level, n < 3 AS thin FROM cubed")
def time_to_sale_cube(spark: SparkSession, d: str) -> DataFrame:
    return market.time_to_sale_cube(A.listings(spark, d, sales=True), ["model", "color", "storage_gb"])


@query(f"WITH {O.SALES}, {_SOLD}, {_VOLUMES}, {_MONTHLY}, {_TREND} SELECT model, coalesce(volume, 0) AS volume, inflow, sold, avg_days, (last_avg - first_avg) / first_avg * 100 AS change_pct FROM volumes FULL JOIN sold USING (model) FULL JOIN trends USING (model)")
def model_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d, sales=True)
    volumes = market.model_boxes(rows, A.as_of()).select("model", "volume", "inflow")
    return market.model_overview(volumes, market.sold_stats(rows, A.as_of()).select("model", "sold", "avg_days"), _trends(spark, d))


_DEALS = f"""WITH {O.LISTINGS}, lines AS (SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS buy_price, list_sort(list({{'label': l_returnflag, 'amount': (l_extendedprice * l_tax)::DECIMAL(18, 4)::DOUBLE}})) AS extra, min(l_shipdate) AS first_at FROM lineitem GROUP BY 1),
deals AS (SELECT id, ['valutazione', 'contattato', 'offerta', 'acquistato', 'in_vendita', 'venduto'][id % 6 + 1] AS stage, buy_price, list_reduce(list_concat([0.0::DOUBLE], list_transform(extra, lambda e: e.amount)), lambda a, b: a + b) AS extra, price AS sell_price, price * 1.25::DOUBLE AS market_avg, price * 0.01::DOUBLE AS carry_month,
  least(found_at, first_at) AS created_at, greatest(found_at, first_at) AS updated_at FROM listings JOIN lines ON id = l_orderkey),
invested AS (SELECT *, buy_price + extra AS invested, greatest(0, floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(updated_at)) / 86400000000::DOUBLE))::BIGINT AS stage_days,
  CASE stage WHEN 'valutazione' THEN 7 WHEN 'contattato' THEN 5 WHEN 'offerta' THEN 5 WHEN 'acquistato' THEN 14 WHEN 'in_vendita' THEN 30 END AS stage_limit FROM deals),
profits AS (SELECT *, CASE WHEN stage = 'venduto' AND invested <> 0 THEN sell_price - invested END AS profit, CASE WHEN stage = 'venduto' THEN greatest(0, floor((epoch_us(updated_at) - epoch_us(created_at)) / 86400000000::DOUBLE))::BIGINT END AS held_days FROM invested),
results AS (SELECT *, CASE WHEN invested <> 0 THEN profit / invested * 100 END AS margin_pct, profit - (market_avg - invested) AS estimate_error, CASE WHEN held_days > 0 THEN profit / invested * 100 / held_days END AS roi_per_day,
  CASE WHEN stage_days >= 2 * stage_limit THEN 'critico' WHEN stage_days >= stage_limit THEN 'fermo' END AS staleness, CASE WHEN stage IN ('acquistato', 'in_vendita') THEN carry_month * stage_days / 30 END AS accrued_loss FROM profits)"""


@query(f"{_DEALS} SELECT id, stage, invested, profit, margin_pct, estimate_error, held_days, roi_per_day FROM results")
def deal_pnl(spark: SparkSession, d: str) -> DataFrame:
    return history.deal_results(A.deals(spark, d), A.as_of()).select("id", "stage", "invested", "profit", "margin_pct", "estimate_error", "held_days", "roi_per_day")


@query(f"{_DEALS} SELECT id, stage, stage_days, staleness, accrued_loss FROM results WHERE staleness IS NOT NULL")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return history.deal_results(A.deals(spark, d), A.as_of()).filter(F.col("staleness").isNotNull()).select("id", "stage", "stage_days", "staleness", "accrued_loss")


@query(f"""{_DEALS} SELECT count(*) AS deals, count(*) FILTER (WHERE stage = 'venduto') AS sold, count(*) FILTER (WHERE stage IN ('acquistato', 'in_vendita')) AS open, count(*) FILTER (WHERE staleness IS NOT NULL) AS stale, count(*) FILTER (WHERE staleness = 'critico') AS critical,
round(sum(profit) / 1000000) AS realised_millions, round(sum(invested) FILTER (WHERE stage IN ('acquistato', 'in_vendita')) / 1000000) AS open_millions, round(sum(accrued_loss) / 1000000) AS loss_millions FROM results""")
def deals_summary(spark: SparkSession, d: str) -> DataFrame:
    out = history.deals_summary(history.deal_results(A.deals(spark, d), A.as_of()))
    return out.select("deals", "sold", "open", "stale", "critical", F.round(F.col("realised") / 1e6).alias("realised_millions"), F.round(F.col("open_invested") / 1e6).alias("open_millions"), F.round(F.col("accrued_loss") / 1e6).alias("loss_millions"))


@query("""WITH prices AS (SELECT p_type AS line, p_size // 10 + 11 AS number, list_sort(list(p_retailprice)) AS p FROM part GROUP BY 1, 2 HAVING count(*) >= 3),
medians AS (SELECT line, number, CASE WHEN len(p) % 2 = 1 THEN p[(len(p) + 1) // 2] ELSE (p[len(p) // 2] + p[len(p) // 2 + 1]) / 2 END AS median_price, len(p)::BIGINT AS n FROM prices),
placed AS (SELECT *, lead(number) OVER w AS older_number, lead(median_price) OVER w AS older_price, first_value(median_price) OVER w AS newest_price, count(*) OVER (PARTITION BY line) AS generations FROM medians WINDOW w AS (PARTITION BY line ORDER BY number DESC)),
lost AS (SELECT *, CASE WHEN number - older_number <= 3 THEN (median_price - older_price) / (number - older_number) END AS loss_year FROM placed WHERE generations > 1)
SELECT line, number::INTEGER AS number, median_price, n, loss_year, loss_year / median_price * 100 AS loss_pct, loss_year / 12 AS loss_month, median_price / newest_price * 100 AS retention_pct, date_diff('day', make_date(2008 + number, 9, 1), DATE '2026-09-01') / 365.25::DOUBLE AS age_years FROM lost""")
def depreciation_lag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_type").alias("line"), (F.floor(F.col("p_size") / 10) + 11).cast("int").alias("number"), F.col("p_retailprice").alias("price"))
    return history.depreciation(rows, F.lit("2026-09-01").cast("date"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return A.runs(spark, d).withColumn("status", history.run_status(F.col("targets"), F.col("ok"), F.col("failed"), F.col("scraped")))


@query(f"""WITH {O.RUNS}, lagged AS (SELECT *, lag(status) OVER (PARTITION BY category ORDER BY ran_at, id) AS before FROM judged)
SELECT id, category, status, CASE WHEN status = 'down' THEN 'went_down' ELSE 'recovered' END AS transition FROM lagged WHERE (status = 'down' AND coalesce(before, '') <> 'down') OR (status <> 'down' AND before = 'down')""")
def health_transitions(spark: SparkSession, d: str) -> DataFrame:
    return history.health_transitions(_runs(spark, d)).select("id", "category", "status", "transition")


@query(f"""WITH {O.RUNS}, recent AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ran_at DESC, id DESC) AS nth FROM judged)
SELECT category, count(*) AS runs, sum(CASE WHEN ran_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOURS THEN new_count ELSE 0 END)::BIGINT AS new_24h, count(*) FILTER (WHERE status = 'ok') AS ok_runs FROM recent WHERE nth <= 20 GROUP BY category""")
def runs_last20_24h(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return history.recent_runs(_runs(spark, d)).groupBy("category").agg(F.count("*").alias("runs"), F.sum(F.when(F.col("ran_at") >= since, F.col("new_count")).otherwise(0)).cast("long").alias("new_24h"), F.count_if(F.col("status") == "ok").alias("ok_runs"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS nth FROM lineitem) WHERE nth = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return incremental.first_of(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_new(spark: SparkSession, d: str) -> DataFrame:
    return incremental.only_new(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def semi_join_saved(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "orders").filter("o_totalprice > 490000").withColumnRenamed("o_custkey", "c_custkey")
    return incremental.only_known(table(spark, d, "customer"), saved, "c_custkey").select("c_custkey", "c_mktsegment")


@query("""WITH batch AS (SELECT o_orderkey, o_totalprice * 0.5::DOUBLE AS o_totalprice, 1 AS turn FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey + 100000000, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'P'),
every AS (SELECT o_orderkey, o_totalprice, 0 AS turn FROM orders UNION ALL SELECT * FROM batch)
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY turn DESC, o_totalprice) AS nth FROM every) WHERE nth = 1""")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """The batch: urgent orders at half price, and partial ones under new keys."""
    orders = table(spark, d, "orders")
    cheaper = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") * 0.5).alias("o_totalprice"))
    added = orders.filter("o_orderstatus = 'P'").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), "o_totalprice")
    return incremental.upserted(orders.select("o_orderkey", "o_totalprice"), cheaper.unionByName(added), ["o_orderkey"], [F.col("o_totalprice")])


_SCORE = """scored AS (SELECT *, greatest(0, least(100, round_even(CASE WHEN margin_pct > 0 THEN least(margin_pct, 33.0::DOUBLE) / 33 * 55 ELSE 0.0::DOUBLE END
  + CASE WHEN hours <= 2 THEN 12 WHEN hours <= 24 THEN 8 WHEN hours <= 72 THEN 4 ELSE 0 END + CASE WHEN seller_id % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN seller_id % 2 = 0 THEN 8 ELSE 2 END + CASE WHEN id % 4 = 0 THEN 8 ELSE 0 END
  - least(4 * (id % 5), 12) + least(2 * (id % 3), 4) + CASE WHEN category <> 'automobile' THEN CASE WHEN storage_gb >= 256 THEN 3 WHEN storage_gb < 128 THEN -3 ELSE 0 END ELSE 0 END, 0)))::INTEGER AS score
  FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(found_at)) / 86400000000::DOUBLE * 24 AS hours FROM valued))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _valued(spark, d)
    seller = F.when(F.col("seller_id") % 2 == 0, "privato").otherwise("finto_privato")
    battery = F.when(F.col("storage_gb") >= 256, 90).when(F.col("storage_gb") < 128, 84).otherwise(87)
    score = valuation.deal_score(F.col("category"), F.col("margin_pct"), valuation.freshness_points(F.col("found_at"), A.as_of()), seller, F.col("id") % 5, F.when(F.col("seller_id") % 3 == 0, 1).otherwise(0), F.col("id") % 3, battery, F.col("id") % 4 == 0)
    return rows.withColumn("score", score)


@query(f"WITH {O.LISTINGS}, {POOLS}, {VALUED}, {_SCORE} SELECT id, margin_pct, score FROM scored")
def deal_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "margin_pct", "score")


@query(f"""WITH {O.LISTINGS}, {POOLS}, {VALUED}, summed AS (SELECT id, CASE WHEN id % 7 = 0 THEN 45 ELSE 0 END + CASE WHEN deal_class = 'sospetto' THEN 25 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 12 ELSE 0 END + CASE WHEN seller_id % 2 = 1 THEN 10 ELSE 0 END + CASE WHEN seller_id % 4 = 0 THEN 6 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 30 ELSE 0 END AS total FROM valued)
SELECT id, CASE WHEN total > 0 THEN least(total, 100) END AS risk, CASE WHEN total >= 45 THEN 'alto' WHEN total >= 20 THEN 'medio' WHEN total > 0 THEN 'basso' END AS level FROM summed""")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    defects = F.array_compact(F.array(F.when(F.col("id") % 7 == 0, "icloud-bloccato").otherwise(none), F.when(F.col("id") % 5 == 0, "per-ricambi").otherwise(none)))
    text = F.when(F.col("id") % 11 == 0, "Pagamento anticipato, solo spedizione").otherwise("ritiro a mano")
    score = valuation.risk_score(defects, text, F.col("deal_class"), F.lit(False), F.when(F.col("seller_id") % 2 == 1, "finto_privato"), F.when(F.col("seller_id") % 4 == 0, 0).otherwise(1))
    return _valued(spark, d).select("id", score.alias("risk")).withColumn("level", valuation.risk_level(F.col("risk")))


@query(f"""WITH {O.LISTINGS}, {POOLS}, {VALUED}, terms AS (SELECT *, CASE WHEN category = 'automobile' THEN 50.0::DOUBLE ELSE 10.0::DOUBLE END AS step, CASE WHEN category = 'automobile' THEN (id % 3) * 300 ELSE 0 END AS penalty, CASE WHEN category = 'automobile' THEN 0 ELSE CASE id % 2 WHEN 0 THEN 290 ELSE 0 END END AS repair,
  1 - CASE WHEN category = 'automobile' THEN 15.0::DOUBLE ELSE 18.0::DOUBLE END / 100 AS kept FROM valued),
raws AS (SELECT *, least(fair_value * kept - penalty - repair, CASE WHEN price > 0 THEN price * 0.93::DOUBLE END) AS offer_raw, fair_value * kept - penalty - repair - 25 AS bid_raw FROM terms)
SELECT id, CASE WHEN offer_raw > 0 THEN offer_raw - fmod(offer_raw, step) END AS offer, CASE WHEN bid_raw > 0 THEN bid_raw - fmod(bid_raw, step) END AS bid FROM raws""")
def max_bid_offer(spark: SparkSession, d: str) -> DataFrame:
    rows = _valued(spark, d)
    car = F.col("category") == "automobile"
    defects = F.when(car, F.array_repeat(F.lit("graffi"), (F.col("id") % 3).cast("int"))).otherwise(F.when(F.col("id") % 2 == 0, F.array(F.lit("schermo-rotto"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("defects", defects)
    penalty, repair = valuation.defect_penalty(F.col("category"), F.col("defects")), valuation.repair_cost(F.col("category"), F.lit("iPhone"), F.col("defects"))
    return rows.select("id", valuation.suggested_offer(F.col("category"), F.col("fair_value"), F.col("price"), penalty, repair).alias("offer"), valuation.max_bid(F.col("category"), F.col("fair_value"), penalty, repair, F.lit(25)).alias("bid"))


@query(f"WITH {O.LISTINGS}, {POOLS}, {VALUED}, {_SCORE} SELECT id, score FROM scored WHERE deal_class = 'affare' AND score >= 55 AND tier <> 'come-nuovo'")
def alert_claim(spark: SparkSession, d: str) -> DataFrame:
    candidates = _scored(spark, d).withColumn("listing_id", F.col("id")).withColumn("alert_type", F.lit("affare"))
    sent = A.listings(spark, d).filter("tier = 'come-nuovo'").select(F.col("id").alias("listing_id"), F.lit("affare").alias("alert_type"))
    return incremental.alerts_to_send(candidates, sent).select("id", "score")


@query("""WITH marked AS (SELECT doc_id, source, md5(regexp_replace(lower(text), '[^a-z]+', '', 'g')) AS h FROM documents),
stored AS (SELECT h, min(doc_id) AS old_id FROM marked WHERE source < 'src15' GROUP BY h), fresh AS (SELECT h, min(doc_id) AS new_id FROM marked WHERE source >= 'src15' GROUP BY h) SELECT new_id, old_id FROM fresh JOIN stored USING (h)""")
def republish_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Documents of some sources are the stored listings, those of the others the new ones."""
    marked = table(spark, d, "documents").select("doc_id", "source", F.md5(F.regexp_replace(F.lower("text"), "[^a-z]+", "")).alias("h"))
    return incremental.republished(marked.filter("source >= 'src15'"), marked.filter("source < 'src15'"), "doc_id", "h")


_TAG = " || ',' || ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{tag}' ELSE '' END" for tag, words in {"rosso": ("rosso", "red"), "oro": ("oro", "gold"), "verde": ("verde", "green"), "spazio": ("spazio", "far posto")}.items())


@query(f"WITH f AS (SELECT doc_id, strip_accents(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, {_TAG} AS tags FROM f")
def text_tags(spark: SparkSession, d: str) -> DataFrame:
    lists = {"rosso": ("rosso", "red"), "oro": ("oro", "gold"), "verde": ("verde", "green"), "spazio": ("spazio", "far posto")}
    joined = T.once(T.tags(T.folded(F.col("text")), lists), lambda found: F.concat_ws(",", *[F.when(F.array_contains(found, tag), tag).otherwise("") for tag in lists]))
    return table(spark, d, "documents").select("doc_id", joined.alias("tags"))


def _listed(lists: dict[str, tuple[str, ...]], text: str = "t") -> str:
    """Tags of a dictionary in their order, as a DuckDB list."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    each = ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + f" THEN {quoted(tag)} END" for tag, words in lists.items())
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


_SIGNAL_TEXT = "left(coalesce(text, ''), 40) AS title, substr(coalesce(text, ''), 41) AS description"
_BROKEN = ", ".join(f"'{tag}'" for tag in T.NOT_MARKET)


@query(f"""WITH cut AS (SELECT doc_id, {_SIGNAL_TEXT} FROM documents), raw AS (SELECT doc_id, CASE WHEN title = '' THEN description WHEN description = '' THEN title ELSE title || ' ' || description END AS r FROM cut),
folded AS (SELECT doc_id, strip_accents(regexp_replace(lower(r), '\\s+', ' ', 'g')) AS t FROM raw),
found AS (SELECT doc_id, list_concat({_listed(T.CAR_FEATURES)}, {_listed(T.PHONE_FEATURES)}) AS f, list_concat({_listed(T.CAR_DEFECTS)}, {_listed(T.PHONE_DEFECTS)}) AS d, {_listed(T.URGENCY)} AS u, {_listed(T.COLORS)}[1] AS color FROM folded),
kept AS (SELECT *, CASE WHEN list_contains(f, 'Batteria-Cambiata') THEN list_filter(d, lambda x: x <> 'batteria-esausta') ELSE d END AS e FROM found)
SELECT doc_id, array_to_string(f, ',') AS features, array_to_string(e, ',') AS defects, array_to_string(u, ',') AS urgency, color, list_has_any(e, [{_BROKEN}]) AS excluded FROM kept""")
def listing_signals(spark: SparkSession, d: str) -> DataFrame:
    """The parser's dictionaries over all documents: their first 40 characters as titles, the rest as descriptions."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", F.substring(text, 1, 40).alias("title"), F.substring(text, 41, 2**31 - 1).alias("description"))
    parsed = listings.parse_listings(rows)
    return parsed.select("doc_id", F.array_join("features", ",").alias("features"), F.array_join("defects_noted", ",").alias("defects"), F.array_join("urgency_flags", ",").alias("urgency"), "color", F.col("exclude_from_iqr").alias("excluded"))


@query("""WITH m AS (SELECT page_id, html || ' 256 GB 1998 ' || page_id || ' gb' AS t FROM pages)
SELECT page_id, CASE WHEN regexp_matches(t, '(?i)\\b1\\s*(?:tb|tera)\\b') THEN 1024 ELSE TRY_CAST(regexp_extract(t, '(?i)\\b(64|128|256|512)\\s*(?:gb|giga)\\b', 1) AS INTEGER) END AS storage_gb,
list_max(list_transform(regexp_extract_all(t, '\\b(19[89]\\d|20[0-2]\\d)\\b', 1), lambda y: y::INTEGER)) AS year FROM m""")
def storage_year_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("html"), F.lit(" 256 GB 1998 "), F.col("page_id").cast("string"), F.lit(" gb"))
    return table(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", T.storage_gb(F.col("t")).alias("storage_gb"), T.year(F.col("t")).alias("year"))


@query("""WITH c AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT page_id, nullif(regexp_extract(u, '(\\d+)(?:\\.html?)?/?$', 1), '') AS listing_id, regexp_extract(u, '([^/]+)/?$', 1) AS slug FROM c""")
def url_slug_id(spark: SparkSession, d: str) -> DataFrame:
    last = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]+)/?$", 1)
    return table(spark, d, "pages").select("page_id", T.id_of_url(F.col("url")).alias("listing_id"), last.alias("slug"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query(f"""WITH {O.LISTINGS}, aged AS (SELECT id, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(found_at)) / 86400000000::DOUBLE AS age FROM listings)
SELECT id, greatest(floor(age), 0)::BIGINT AS days_online, CASE WHEN age * 24 <= 2 THEN 12 WHEN age * 24 <= 24 THEN 8 WHEN age * 24 <= 72 THEN 4 ELSE 0 END AS freshness FROM aged""")
def days_online_bucket(spark: SparkSession, d: str) -> DataFrame:
    return A.listings(spark, d).select("id", whole_days(F.col("found_at"), A.as_of()).alias("days_online"), valuation.freshness_points(F.col("found_at"), A.as_of()).alias("freshness"))


@query(f"WITH {O.LISTINGS}, {POOLS}, {VALUED}, {_SCORE} SELECT id, score, margin_pct, deal_class FROM scored WHERE {O.ACTIVE} AND price BETWEEN 20000 AND 400000 AND color = 'Blu' AND margin_pct >= 20 AND deal_class <> 'sospetto' ORDER BY score DESC, id LIMIT 20 OFFSET 5")
def feed_topk_page(spark: SparkSession, d: str) -> DataFrame:
    wanted = feed.Wanted(min_price=20_000, max_price=400_000, color="Blu", min_margin=20, deal_classes=("affare", "in-linea", "caro"))
    return feed.page(feed.filtered(_scored(spark, d), wanted), "score", offset=5, size=20).select("id", "score", "margin_pct", "deal_class")


@query("""WITH mine AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'), theirs AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderpriority < '3')
SELECT o_orderkey, o_totalprice, o_orderstatus FROM mine UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM theirs WHERE o_orderkey NOT IN (SELECT o_orderkey FROM mine)""")
def merge_additive(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    theirs = orders.filter("o_orderpriority < '3'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return incremental.merged(orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", "o_orderstatus"), theirs, "o_orderkey")


@query(f"WITH {O.LISTINGS}, a AS (SELECT seller_id FROM listings WHERE {O.ACTIVE} AND category = 'automobile') SELECT seller_id, count(*) AS listings FROM a GROUP BY seller_id HAVING count(*) > 3")
def reclassify_sellers(spark: SparkSession, d: str) -> DataFrame:
    cars = A.listings(spark, d).filter(market.is_active(F.col("status")) & (F.col("category") == "automobile"))
    return history.needs_reclassifying(cars.filter("tier = 'buono'"), cars.filter("tier <> 'buono'"))


@query("""WITH new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.85::DOUBLE ELSE o_totalprice * 1.1::DOUBLE END AS new_price, o_totalprice AS old_price FROM orders), drops AS (SELECT id, old_price, new_price, (old_price - new_price) / old_price * 100 AS drop_pct FROM new WHERE new_price < old_price)
SELECT * FROM drops""")
def price_drop_events(spark: SparkSession, d: str) -> DataFrame:
    stored = A.listings(spark, d).select("id", "price")
    batch = stored.withColumn("price", F.when(F.col("id") % 2 == 0, F.col("price") * 0.85).otherwise(F.col("price") * 1.1))
    return incremental.price_drops(batch, stored, "id")


@query(f"""WITH {O.LISTINGS}, j AS (SELECT id, CASE WHEN category = 'automobile' THEN price BETWEEN 1000 AND 200000 ELSE price >= 50 END AS ok, 1990 + id % 40 AS year, id % 300000 AS km FROM listings)
SELECT CASE WHEN year < 2005 THEN 'anno' WHEN km > 9000 THEN 'km' END AS reason, ok AS in_bounds, count(*) AS n FROM j GROUP BY 1, 2""")
def filter_breakdown(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    reason = listings.first_failing(F.lit(2005), none, F.lit(9000), F.lit(None).cast("string"), 1990 + F.col("id") % 40, F.col("id") % 300000, F.lit("manuale"))
    rows = A.listings(spark, d).select(reason.alias("reason"), listings.price_in_bounds(F.col("category"), F.col("price")).alias("in_bounds"))
    return rows.groupBy("reason", "in_bounds").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice AS sell, o_totalprice * 0.7::DOUBLE AS buy FROM orders), p AS (SELECT *, sell - buy - sell * 5 / 100 - 10 AS profit FROM c) SELECT o_orderkey, profit, profit / sell * 100 AS margin_pct FROM p""")
def margin_calculator(spark: SparkSession, d: str) -> DataFrame:
    sell = F.col("o_totalprice")
    profit, share = valuation.margin_calculator(sell * 0.7, sell, F.lit(5), F.lit(10))
    return table(spark, d, "orders").select("o_orderkey", profit.alias("profit"), share.alias("margin_pct"))


_ENRICHED = f"""WITH {O.SALES}, {POOLS}, {_SOLD_REFS}, {O.HISTORY}, {_SOLD}, {_MONTHLY},
base AS (SELECT *, CASE WHEN category = 'automobile' THEN id * 7919 % 180000 + 1000 END AS km, id % 6 <> 0 AS has_photo, CASE WHEN seller_id % 2 = 0 THEN 'privato' ELSE 'finto_privato' END AS seller_type,
  CASE WHEN category = 'automobile' THEN CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END END AS n_defects FROM sales),
lines AS (SELECT variant_key, regr_slope(price, km) AS slope, regr_intercept(price, km) AS intercept FROM base WHERE category = 'automobile' AND {O.ACTIVE} AND price > 0 GROUP BY variant_key HAVING count(*) >= 8 AND regr_slope(price, km) < 0),
stats AS (SELECT variant_key, {O.mean("p")} AS pool_mean, {O.median("p")} AS pool_median, len(p)::BIGINT AS pool_n FROM pools),
ref AS (SELECT variant_key, tier, {O.median("p")} AS mid, len(p)::BIGINT AS n FROM refs),
series AS (SELECT model, trend_date, {O.mean("p")} AS avg_price FROM snap), averages AS (SELECT model, arg_max(avg_price, trend_date) AS model_avg FROM series GROUP BY model),
changed AS (SELECT listing_id AS id, min({{'a': changed_at, 'b': new_price, 'c': old_price}}) AS f, max({{'a': changed_at, 'b': new_price, 'c': old_price}}) AS l, count(*) FILTER (WHERE new_price < old_price) AS drops FROM history GROUP BY listing_id),
sellers AS (SELECT seller_id, count(*) FILTER (WHERE status <> 'venduto_rimosso') AS seller_active, count(*) FILTER (WHERE status = 'venduto_rimosso') AS seller_sold,
  coalesce(sum((epoch_us(sold_at) - epoch_us(found_at)) / 86400000000::DOUBLE) FILTER (WHERE sold_at >= found_at AND sold_at <= found_at + INTERVAL 365 DAYS) / count(*) FILTER (WHERE sold_at >= found_at AND sold_at <= found_at + INTERVAL 365 DAYS) <= 14, false)
  OR count(*) FILTER (WHERE c.drops > 0) / count(*) * 100 >= 40 AS seller_motivated FROM base LEFT JOIN changed c USING (id) GROUP BY seller_id),
met AS (SELECT b.*, coalesce(pool_mean, model_avg) AS market_avg, pool_median, coalesce(pool_n, 0) AS pool_n, t.mid AS sold_tier, coalesce(t.mid, a.mid) AS sold_reference, coalesce(t.n, a.n, 0) AS sold_n, avg_days AS sold_days, seller_active, seller_sold, seller_motivated,
    CASE WHEN b.category = 'automobile' THEN intercept + slope * km END AS km_estimate, CASE WHEN b.category <> 'automobile' THEN length(b.variant_key) * 10 END AS carry_month, drops, c.f.c AS first_price, c.l.b AS last_price, c.id IS NOT NULL AS changed
  FROM base b LEFT JOIN stats USING (variant_key) LEFT JOIN ref t ON b.variant_key = t.variant_key AND b.tier = t.tier LEFT JOIN ref a ON b.variant_key = a.variant_key AND a.tier = '__all__'
  LEFT JOIN lines ON b.variant_key = lines.variant_key LEFT JOIN averages USING (model) LEFT JOIN sold ON b.model = sold.model LEFT JOIN changed c ON b.id = c.id LEFT JOIN sellers USING (seller_id)),
fairs AS (SELECT *, CASE WHEN km_estimate > 0 THEN km_estimate ELSE coalesce(sold_reference, pool_median) END * CASE WHEN sold_tier IS NOT NULL AND NOT coalesce(km_estimate > 0, false) THEN 1.0::DOUBLE
    WHEN category = 'automobile' THEN CASE tier WHEN 'difetti' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END ELSE CASE tier WHEN 'come-nuovo' THEN 1.08::DOUBLE WHEN 'difetti' THEN 0.82::DOUBLE WHEN 'rotto' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END END AS fair FROM met),
classed AS (SELECT *, (fair - price) / price * 100 AS margin_pct, coalesce(fair, market_avg) AS reference,
    CASE WHEN fair IS NULL THEN 'n/d' WHEN price / fair < 0.55::DOUBLE OR ((fair - price) / price * 100 >= 15 AND price / fair < 0.65::DOUBLE AND NOT has_photo) THEN 'sospetto' WHEN (fair - price) / price * 100 >= 15 THEN 'affare' WHEN price / fair > 1.15::DOUBLE THEN 'caro' ELSE 'in-linea' END AS class,
    CASE WHEN category <> 'automobile' AND n_defects = 1 THEN 290 ELSE 0 END AS repair, CASE WHEN category = 'automobile' THEN n_defects * 300 ELSE 0 END AS penalty, CASE WHEN sold_days > 0 THEN floor(sold_days) ELSE 30 END::INTEGER AS hold_days,
    CASE WHEN category = 'automobile' THEN 50.0::DOUBLE ELSE 10.0::DOUBLE END AS step, 1 - CASE WHEN category = 'automobile' THEN 15.0::DOUBLE ELSE 18.0::DOUBLE END / 100 AS kept, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(found_at)) / 86400000000::DOUBLE * 24 AS hours FROM fairs),
bids AS (SELECT *, round_even(carry_month * hold_days / 30, 0)::INTEGER AS carry_total, least(reference * kept - penalty - repair, price * 0.93::DOUBLE) AS offer_raw FROM classed),
limits AS (SELECT *, coalesce(sold_reference, market_avg, reference) * kept - penalty - repair - coalesce(carry_total, 0) AS bid_raw, CASE WHEN repair > 0 THEN (reference - price - repair) / (price + repair) * 100 ELSE coalesce(margin_pct, (market_avg - price) / price * 100) END AS scored_pct FROM bids),
points AS (SELECT *, CASE WHEN bid_raw > 0 THEN bid_raw - fmod(bid_raw, step) END AS bid, CASE WHEN class = 'sospetto' THEN 0 ELSE greatest(0, least(100, round_even(CASE WHEN scored_pct > 0 THEN least(scored_pct, 33.0::DOUBLE) / 33 * 55 ELSE 0.0::DOUBLE END
    + CASE WHEN hours <= 2 THEN 12 WHEN hours <= 24 THEN 8 WHEN hours <= 72 THEN 4 ELSE 0 END + CASE seller_type WHEN 'privato' THEN 8 ELSE 2 END + CASE WHEN changed THEN 8 ELSE 0 END - 4 * n_defects, 0))) END::INTEGER AS score,
    CASE WHEN class = 'sospetto' THEN 25 ELSE 0 END + CASE WHEN seller_type = 'finto_privato' THEN 10 ELSE 0 END + CASE WHEN seller_sold = 0 THEN 6 ELSE 0 END AS signals FROM limits)"""


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d, sales=True)
    car, i = F.col("category") == "automobile", F.col("id")
    some = lambda condition, defect: F.when(condition, F.array(F.lit(defect))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({
        "km": F.when(car, i * 7919 % 180000 + 1000).cast("int"), "has_photo": i % 6 != 0, "seller_type": F.when(F.col("seller_id") % 2 == 0, "privato").otherwise("finto_privato"), "title": F.lit("iPhone 13"),
        "defects_noted": F.when(car, some(i % 3 == 0, "graffi")).otherwise(some(i % 4 == 1, "schermo-rotto")),
    })
    rows = stage(rows, "market")  # a stored table, as many references are read from it
    averages = market.latest_averages(market.market_snapshot(rows, "model", F.trunc("found_at", "month")), "model")
    carry = rows.filter(~car).select("variant_key").distinct().withColumn("carry_month", F.length("variant_key") * 10)
    return enrichment.enrich(rows, A.as_of(), changes=A.history(spark, d), by_model=averages, carry=carry, km_key="variant_key")


@query(f"""{_ENRICHED} SELECT id, market_avg, round(fair) AS fair_value, CASE WHEN fair IS NULL THEN NULL WHEN km_estimate IS NOT NULL THEN 'km' WHEN sold_reference > 0 THEN 'venduti' ELSE 'listati' END AS fair_source, class AS deal_class, pool_n + sold_n AS samples,
CASE WHEN pool_n + sold_n >= 15 THEN 'alta' WHEN pool_n + sold_n >= 6 THEN 'media' ELSE 'bassa' END AS confidence, CASE WHEN drops > 0 AND first_price > last_price THEN drops END AS drops, seller_active, seller_sold, seller_motivated, hold_days, carry_total,
CASE WHEN offer_raw > 0 THEN offer_raw - fmod(offer_raw, step) END AS suggested_offer, round(bid) AS max_bid, coalesce(price <= bid, false) AS buy_at_asking, round(CASE WHEN repair > 0 THEN reference - price - repair END) AS repair_margin_eur, score,
CASE WHEN signals > 0 THEN signals END AS risk, CASE WHEN signals >= 45 THEN 'alto' WHEN signals >= 20 THEN 'medio' WHEN signals > 0 THEN 'basso' END AS risk_level FROM points""")
def enriched_listings(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).select(
        "id", "market_avg", F.round("fair_value").alias("fair_value"), "fair_source", "deal_class", "samples", "confidence", F.col("price_watch.drops").alias("drops"), "seller_active", "seller_sold", "seller_motivated", "hold_days", "carry_total",
        "suggested_offer", F.round("max_bid").alias("max_bid"), "buy_at_asking", F.round("repair_margin_eur").alias("repair_margin_eur"), "score", "risk", "risk_level",
    )


@query(f"{_ENRICHED} SELECT id, score, deal_class FROM (SELECT id, score, class AS deal_class, found_at FROM points WHERE {O.ACTIVE} AND class <> 'sospetto') ORDER BY found_at DESC NULLS LAST, id LIMIT 50 OFFSET 20")
def feed_recent_page(spark: SparkSession, d: str) -> DataFrame:
    wanted = feed.Wanted(deal_classes=("affare", "in-linea", "caro", "n/d"))
    return feed.page(feed.filtered(_enriched(spark, d), wanted), "recent", offset=20, size=50).select("id", "score", "deal_class")


@query(f"{_ENRICHED} SELECT count(*) AS total, count(*) FILTER (WHERE price <= bid) AS bargains FROM points WHERE {O.ACTIVE} AND class = 'affare'")
def feed_total(spark: SparkSession, d: str) -> DataFrame:
    return feed.filtered(_enriched(spark, d), feed.Wanted(deal_classes=("affare",))).agg(F.count("*").alias("total"), F.count_if("buy_at_asking").alias("bargains"))
