"""Depreciation, deals, analysis, fleet, merging, nightly and backfill jobs as queries, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import text as T
from tallymart.operators import alerts, analysis, backfill, deals, depreciation, fleet, history, labels, market, merging, nightly
from tallymart.params import CAR
from tallymart.plans import adapter as A
from tallymart.plans import oracles as O
from tallymart.plans.queries import _DEALS
from tallymart.plans.registry import Registry
from tallymart.sources import paged, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# Depreciation

PHONES = """parts AS (SELECT l_orderkey AS id, ['', 'mini', 'plus', 'air', 'pro', 'pro-max', 'e'][(p_partkey // 7) % 7 + 1] AS line, [64, 128, 256, 512, 1024, NULL][p_size % 6 + 1] AS storage_gb, p_partkey, l_extendedprice AS price, l_linestatus, l_returnflag
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_extendedprice, l_linestatus, l_returnflag) AS turn FROM lineitem WHERE l_linenumber = 7) JOIN part ON l_partkey = p_partkey WHERE turn = 1),
numbered AS (SELECT *, CASE WHEN line = 'air' THEN 11 + 5 * (p_partkey % 2) ELSE 11 + p_partkey % 7 END AS number FROM parts),
phones AS (SELECT id, number, line, storage_gb, price, CASE WHEN l_linestatus = 'O' THEN 'nuovo' ELSE 'venduto_rimosso' END AS status, CASE l_returnflag WHEN 'R' THEN 'rotto' WHEN 'A' THEN 'come-nuovo' ELSE 'buono' END AS tier,
  'iphone-' || number || CASE line WHEN '' THEN '' WHEN 'e' THEN 'e' ELSE '-' || line END AS model, 'iphone-' || number || CASE line WHEN '' THEN '' WHEN 'e' THEN 'e' ELSE '-' || line END || '-' || coalesce(storage_gb::VARCHAR, 'na') AS variant_key FROM numbered)"""
_NAME = lambda n: f"'iPhone ' || {n} || CASE line WHEN '' THEN '' WHEN 'e' THEN 'e' WHEN 'pro-max' THEN ' Pro Max' WHEN 'mini' THEN ' mini' ELSE ' ' || upper(line[1]) || line[2:] END"
_LABEL = "CASE WHEN storage IS NULL THEN 'tutte' WHEN storage >= 1024 THEN '1TB' ELSE storage || 'GB' END"
_RELEASED = lambda n: f"CASE WHEN line = 'e' THEN make_date(2009 + {n}, 2, 1) ELSE make_date(2008 + {n}, 9, 1) END"
POINTS = f"""{PHONES}, {O.fenced(f"(SELECT * FROM phones WHERE {O.ACTIVE} AND {O.HEALTHY})", "variant_key", "pools", 3)},
flat AS (SELECT DISTINCT variant_key, number, line, storage_gb AS storage FROM phones), asked AS (SELECT number, line, storage, unnest(p) AS price FROM pools JOIN flat USING (variant_key)),
levels AS (SELECT line, storage, false AS merged, number, price FROM asked WHERE storage IS NOT NULL UNION ALL SELECT line, NULL, true, number, price FROM asked),
medians AS (SELECT line, storage, merged, number, round_even(median(price), 0)::BIGINT AS median, count(*) AS sample FROM levels GROUP BY line, storage, merged, number HAVING count(*) >= 3),
placed AS (SELECT *, count(*) OVER (PARTITION BY line, storage, merged) AS generations, first_value(median) OVER w AS newest, lead(number) OVER w AS older, lead(median) OVER w AS older_median FROM medians WINDOW w AS (PARTITION BY line, storage, merged ORDER BY number DESC)),
dated AS (SELECT *, {_RELEASED("number")} AS released_at, round_even(date_diff('day', {_RELEASED("older")}, {_RELEASED("number")}) / 365.25::DOUBLE, 1) AS gap FROM placed WHERE generations >= 2),
lost AS (SELECT *, coalesce(gap > 0 AND gap <= 3 AND median > 0, false) AS near, round_even(CASE WHEN gap > 0 AND gap <= 3 AND median > 0 THEN (median - older_median) / gap END, 0)::BIGINT AS loss_year_eur FROM dated),
points AS (SELECT line, storage::INTEGER AS storage, merged, number, 'iphone-' || number || CASE line WHEN '' THEN '' WHEN 'e' THEN 'e' ELSE '-' || line END AS model_key, {_NAME("number")} AS model, {_LABEL} AS storage_label, released_at,
  round_even(date_diff('day', released_at, DATE '{A.TODAY}') / 365.25::DOUBLE, 2) AS age_years, median, sample, round_even(median::DOUBLE / newest * 100, 1) AS retention_pct, loss_year_eur, round_even(loss_year_eur::DOUBLE / median * 100, 1) AS loss_year_pct,
  round_even(loss_year_eur / 12::DOUBLE, 0)::BIGINT AS loss_month_eur, CASE WHEN near THEN {_NAME("older")} END AS vs_model FROM lost)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    rows = A.phones(spark, d)
    return depreciation.points(market.variant_pools(rows.filter(market.is_active(F.col("status")))), F.lit(A.TODAY).cast("date"))


@query(f"WITH {POINTS} SELECT * REPLACE (released_at::VARCHAR AS released_at, number::INTEGER AS number), CASE WHEN NOT merged THEN model_key || '-' || storage END AS variant_key FROM points")
def depreciation_by_storage(spark: SparkSession, d: str) -> DataFrame:
    return depreciation.ordered_series(_points(spark, d)).drop("line_label").withColumn("released_at", F.col("released_at").cast("string"))


@query(f"WITH {POINTS} SELECT line, storage, merged, sum(sample)::BIGINT AS sample, string_agg(model_key || ':' || median, ',' ORDER BY number DESC) AS points FROM points GROUP BY line, storage, merged")
def depreciation_curves(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["model_key"], p["median"])), ",")
    return depreciation.curves(_points(spark, d)).select("line", "storage", "merged", "sample", listed.alias("points"))


@query(f"WITH {POINTS} SELECT model, storage_label, loss_year_pct FROM points WHERE NOT merged ORDER BY coalesce(loss_year_pct, -1) DESC, line, storage, number DESC LIMIT 40")
def depreciation_table(spark: SparkSession, d: str) -> DataFrame:
    return depreciation.ordered_models(_points(spark, d)).select("model", "storage_label", "loss_year_pct").limit(40)


@query(f"""WITH {POINTS}, rated AS (SELECT * FROM points WHERE NOT merged AND loss_year_pct IS NOT NULL),
best AS (SELECT * FROM rated ORDER BY loss_year_pct, line, storage, number DESC LIMIT 1), worst AS (SELECT * FROM rated ORDER BY loss_year_pct DESC, line, storage, number DESC LIMIT 1)
SELECT b.model AS best_model, b.storage_label AS best_storage_label, b.loss_year_pct AS best_loss_year_pct, w.model AS worst_model, w.storage_label AS worst_storage_label, w.loss_year_pct AS worst_loss_year_pct,
(SELECT round_even(sum(loss_year_pct::DECIMAL(18, 1))::DOUBLE / count(*), 1) FROM rated) AS mean_loss_pct, (SELECT count(*) FROM rated) AS rated FROM best b, worst w""")
def depreciation_summary(spark: SparkSession, d: str) -> DataFrame:
    return depreciation.summary(_points(spark, d))


CARRY = f"{POINTS}, carry AS (SELECT model_key || '-' || storage AS variant_key, loss_month_eur AS carry_month FROM points WHERE NOT merged AND loss_month_eur <> 0)"


@query(f"WITH {CARRY} SELECT * FROM carry")
def carry_cost_by_variant(spark: SparkSession, d: str) -> DataFrame:
    return depreciation.carry_costs(_points(spark, d))


# Deals

_PIPELINE = f"""{_DEALS.replace("price * 0.01::DOUBLE AS carry_month", "NULL::BIGINT AS carry_month").split("invested AS (SELECT *, buy_price")[0].rstrip().rstrip(",")}, {CARRY},
owned AS (SELECT * EXCLUDE (carry_month), CASE WHEN id % 5 <> 0 THEN id - id % 2 END AS listing_id, CASE WHEN id % 7 = 0 THEN 'automobile' ELSE 'smartphone' END AS category FROM deals),
held AS (SELECT o.*, p.variant_key, CASE WHEN category <> 'automobile' THEN carry_month END AS carry_month, buy_price + extra AS invested, greatest(0, floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(updated_at)) / 86400000000::DOUBLE))::BIGINT AS stage_days
  FROM owned o LEFT JOIN phones p ON o.listing_id = p.id LEFT JOIN carry c ON p.variant_key = c.variant_key)"""
_ACCRUED = "CASE WHEN stage IN ('acquistato', 'in_vendita') THEN carry_month * stage_days / 30 END"


def _owned(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return A.deals(spark, d).drop("carry_month").withColumns({"listing_id": F.when(i % 5 != 0, i - i % 2), "category": F.when(i % 7 == 0, CAR).otherwise("smartphone")})


@query(f"{_PIPELINE} SELECT id, listing_id, variant_key, carry_month, invested, stage_days, {_ACCRUED} AS accrued_loss FROM held")
def deals_with_carry(spark: SparkSession, d: str) -> DataFrame:
    held = deals.with_carry(_owned(spark, d), A.phones(spark, d), depreciation.carry_costs(_points(spark, d)))
    return history.deal_results(held, A.as_of()).select("id", "listing_id", "variant_key", "carry_month", "invested", "stage_days", "accrued_loss")


@query(f"{_PIPELINE} SELECT id, stage, variant_key, stage_days, {_ACCRUED} AS accrued_loss FROM held WHERE stage IN ('acquistato', 'in_vendita') ORDER BY updated_at DESC, id LIMIT 200")
def deals_latest(spark: SparkSession, d: str) -> DataFrame:
    out = deals.deal_list(_owned(spark, d), A.phones(spark, d), depreciation.carry_costs(_points(spark, d)), A.as_of(), ("acquistato", "in_vendita"))
    return out.select("id", "stage", "variant_key", "stage_days", "accrued_loss")


@query(f"{_PIPELINE} SELECT id, variant_key, id IN (SELECT listing_id FROM owned WHERE listing_id IS NOT NULL) AS in_pipeline FROM phones")
def listings_in_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return deals.in_pipeline(A.phones(spark, d), _owned(spark, d)).select("id", "variant_key", "in_pipeline")


# Analysis of descriptions


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_REPLY = " || ".join(f"', \"{n}\": ' || {_sql_list(v)}[(event_id // {A.REPLY_EVERY[n]}) % {len(v)} + 1]" for n, v in A.REPLY_VALUES.items())
_TEXT, _KIND = lambda n: f"json_extract_string(reply, '$.{n}')", lambda n: f"json_type(reply, '$.{n}')"
_GIVEN = lambda n: f"(CASE WHEN {_KIND(n)} = 'NULL' OR {_TEXT(n)} IN ('', '[]', '{{}}') OR ({_KIND(n)} = 'BOOLEAN' AND {_TEXT(n)} = 'false') OR ({_KIND(n)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST({_TEXT(n)} AS DOUBLE) = 0) THEN NULL ELSE {_TEXT(n)} END)"
_WHOLE = lambda n: f"(CASE WHEN {_KIND(n)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(TRY_CAST({_TEXT(n)} AS DOUBLE))::BIGINT WHEN {_KIND(n)} = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract({_TEXT(n)}, '\\d+'), '') AS BIGINT) END)"
REPLIES = f"""raw AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'automobile' ELSE 'smartphone' END AS category, CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'no json {{' WHEN 2 THEN '[1, 2]' WHEN 3 THEN props
  ELSE '{{"motivo_prezzo": "' || event_type || '"' || {_REPLY} || '}}' END AS reply FROM events),
objects AS (SELECT * FROM raw WHERE json_valid(reply) AND json_type(reply) = 'OBJECT'),
read AS (SELECT id, category, coalesce({_GIVEN("motivo_prezzo")}, '')[:300] AS motivo_prezzo, coalesce({_GIVEN("sintesi")}, '')[:400] AS sintesi,
  CASE WHEN lower(trim({_TEXT("categoria_motivo")})) IN ('legittimo', 'difetto', 'sospetto') THEN lower(trim({_TEXT("categoria_motivo")})) ELSE 'nessuno' END AS categoria_motivo,
  CASE WHEN lower(trim({_TEXT("rischio_truffa")})) IN ('medio', 'alto') THEN lower(trim({_TEXT("rischio_truffa")})) ELSE 'basso' END AS rischio_truffa,
  coalesce(CASE WHEN {_KIND("riparabile")} = 'VARCHAR' THEN lower(trim({_TEXT("riparabile")})) IN ('true', 'vero', 'si', 'sì', '1') ELSE {_GIVEN("riparabile")} IS NOT NULL END, false) AS riparabile,
  CASE WHEN {_WHOLE("storage_gb")} = 1 THEN 1024 ELSE {_WHOLE("storage_gb")} END AS storage, {_WHOLE("battery_pct")} AS battery, lower(trim({_GIVEN("color")})) AS color FROM objects),
fields AS (SELECT *, CASE WHEN category = 'smartphone' AND storage IN (32, 64, 128, 256, 512, 1024) THEN storage END::INTEGER AS storage_gb, CASE WHEN category = 'smartphone' AND battery BETWEEN 1 AND 100 THEN battery END::INTEGER AS battery_pct,
  CASE WHEN category = 'smartphone' THEN CASE color WHEN 'blu sierra' THEN 'Blu' WHEN 'space black' THEN 'Nero' END END AS color_name FROM read)"""


@query(f"WITH {REPLIES} SELECT id, motivo_prezzo, sintesi, categoria_motivo, rischio_truffa, riparabile, storage_gb, battery_pct, color_name AS color FROM fields")
def analysis_replies(spark: SparkSession, d: str) -> DataFrame:
    good, _ = analysis.parse_replies(A.replies(spark, d))
    return good.select("id", *[f"analysis.{c}" for c in ("motivo_prezzo", "sintesi", "categoria_motivo", "rischio_truffa", "riparabile")], "fields.storage_gb", "fields.battery_pct", "fields.color")


@query(f"WITH {REPLIES} SELECT id, reply FROM raw WHERE id NOT IN (SELECT id FROM objects)")
def analysis_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return analysis.parse_replies(A.replies(spark, d))[1].select("id", "reply")


DESCRIBED = f"""{PHONES}, described AS (SELECT *, CASE WHEN id % 4 <> 0 THEN 'in ottime condizioni' END AS description, CASE id % 3 WHEN 0 THEN 'Rosso' WHEN 1 THEN '' END AS color, CASE WHEN id % 5 = 0 THEN 80 END AS battery_pct,
  id % 6 = 0 AS analysed, CASE WHEN id % 2 = 0 THEN 'privato' ELSE 'finto_privato' END AS seller_type FROM phones)"""
FILLED = f"""{DESCRIBED}, {REPLIES}, met AS (SELECT d.id, d.model, f.categoria_motivo, f.riparabile, d.storage_gb AS s, d.color AS c, d.battery_pct AS b, d.variant_key AS v, f.storage_gb AS fs, f.color_name AS fc, f.battery_pct AS fb
  FROM described d JOIN fields f USING (id) WHERE NOT analysed AND status <> 'venduto_rimosso' AND description IS NOT NULL),
changed AS (SELECT id, coalesce(s, fs)::INTEGER AS storage_gb, CASE WHEN coalesce(c, '') = '' THEN coalesce(fc, c) ELSE c END AS color, coalesce(b, fb)::INTEGER AS battery_pct, CASE WHEN s IS NULL AND fs IS NOT NULL THEN model || '-' || fs ELSE v END AS variant_key, categoria_motivo, riparabile,
  (s IS NULL AND fs IS NOT NULL)::INTEGER + (coalesce(c, '') = '' AND fc IS NOT NULL)::INTEGER + (b IS NULL AND fb IS NOT NULL)::INTEGER AS filled FROM met)"""


def _filled(spark: SparkSession, d: str) -> DataFrame:
    good, _ = analysis.parse_replies(A.replies(spark, d))
    return analysis.fill_missing(analysis.backlog(A.described(spark, d)), good)


@query(f"WITH {FILLED} SELECT * EXCLUDE (riparabile) FROM changed")
def analysis_write_back(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("id", "storage_gb", "color", "battery_pct", "variant_key", "analysis.categoria_motivo", "filled")


@query(f"WITH {DESCRIBED} SELECT id, model FROM described WHERE NOT analysed AND status <> 'venduto_rimosso' AND description IS NOT NULL ORDER BY id LIMIT 30")
def analysis_backlog(spark: SparkSession, d: str) -> DataFrame:
    return analysis.backlog(A.described(spark, d), 30).select("id", "model")


@query(f"""WITH {FILLED}, now AS (SELECT d.model, CASE WHEN analysed THEN 'difetto' ELSE c.categoria_motivo END AS reason, CASE WHEN analysed THEN d.id % 12 = 0 ELSE c.riparabile END AS repairable, analysed OR c.id IS NOT NULL AS done, seller_type FROM described d LEFT JOIN changed c USING (id) WHERE status <> 'venduto_rimosso')
SELECT model, count(*) FILTER (WHERE done) AS analysed, count(*) FILTER (WHERE reason = 'legittimo') AS legittimo, count(*) FILTER (WHERE reason = 'difetto') AS difetto, count(*) FILTER (WHERE reason = 'sospetto') AS sospetto,
count(*) FILTER (WHERE repairable) AS repairable, count(*) FILTER (WHERE seller_type = 'finto_privato') AS fake_private FROM now GROUP BY model""")
def analysis_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows, changed = A.described(spark, d), _filled(spark, d).drop("filled")
    return analysis.distribution(rows.join(changed.select("id"), "id", "left_anti").select(*rows.columns).unionByName(changed))


# Fleet

_STORED = """stored AS (SELECT md5('s' || c_custkey) AS id, CASE WHEN c_custkey % 4 = 0 THEN 'automobile' ELSE 'smartphone' END AS category,
  CASE c_custkey % 4 WHEN 0 THEN 'BMW ' || c_custkey WHEN 1 THEN 'iPhone ' || c_custkey WHEN 2 THEN 'iPhone ' || c_custkey || ' Pro' ELSE 'iPhone ' || c_custkey || ' Pro Max' END AS query, CASE WHEN c_custkey % 3 = 0 THEN '{"min_year": 2008}' ELSE '{}' END AS strict_filters, c_custkey % 5 <> 0 AS is_active FROM customer WHERE c_custkey < 2000)"""
_PHONE_QUERIES = " UNION ALL ".join(f"SELECT {g} AS generation, unnest({_sql_list(tuple(f'iPhone {g} {v}'.strip() for v in variants))}) AS query" for g, variants in fleet.GENERATIONS.items()) + "".join(f" UNION ALL SELECT {g}, '{q}'" for g, q in fleet.SPECIALS)


@query(f"""WITH {_STORED}, wanted AS (SELECT DISTINCT 'smartphone' AS category, query FROM ({_PHONE_QUERIES}) WHERE generation >= 13 UNION ALL SELECT 'automobile', unnest({_sql_list(fleet.CARS)}))
SELECT coalesce(s.id, md5(category || '|' || query)) AS id, category, query, CASE WHEN w.query IS NOT NULL THEN '{{}}' ELSE strict_filters END AS strict_filters, w.query IS NOT NULL AS is_active,
CASE WHEN s.id IS NULL THEN 'insert' WHEN w.query IS NULL THEN CASE WHEN is_active THEN 'deactivate' ELSE 'keep' END WHEN is_active AND strict_filters = '{{}}' THEN 'keep' ELSE 'update' END AS change
FROM (SELECT *, category AS c, query AS q FROM stored) s FULL JOIN (SELECT * FROM wanted) w USING (category, query)""")
def fleet_sync(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("BMW "), key)).when(key % 4 == 1, F.concat(F.lit("iPhone "), key)).when(key % 4 == 2, F.concat(F.lit("iPhone "), key, F.lit(" Pro"))).otherwise(F.concat(F.lit("iPhone "), key, F.lit(" Pro Max")))
    stored = table(spark, d, "customer").filter(key < 2000).select(F.md5(F.concat(F.lit("s"), key)).alias("id"), F.when(key % 4 == 0, CAR).otherwise("smartphone").alias("category"), name.alias("query"), F.when(key % 3 == 0, '{"min_year": 2008}').otherwise("{}").alias("strict_filters"), (key % 5 != 0).alias("is_active"))
    return fleet.fleet_changes(stored, fleet.wanted_fleet(spark))


TARGETS = """targets AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS id, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'automobile' ELSE 'smartphone' END AS category, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || c_nationkey AS query, c_nationkey AS nation, c_nationkey <> 13 AS is_active FROM customer)"""


@query(f"WITH {O.LISTINGS}, {TARGETS} SELECT l.id, variant_key AS target_id, query AS target_name FROM listings l LEFT JOIN (SELECT * FROM targets WHERE is_active) t ON variant_key = t.id")
def listings_with_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = A.listings(spark, d).withColumn("target_id", F.col("variant_key"))
    return fleet.with_target_names(rows, fleet.active_fleet(A.targets(spark, d))).select("id", "target_id", "target_name")


@query("""WITH asked AS (SELECT DISTINCT p_name AS model, CASE WHEN p_size % 2 = 0 THEN 'smartphone' ELSE 'automobile' END AS category FROM part), stored AS (SELECT min(p_partkey)::VARCHAR AS id, p_name AS model, 'smartphone' AS category FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name)
SELECT model, category, coalesce(s.id, md5(category || '|' || model)) AS product_id, s.id IS NULL AS is_new, CASE WHEN s.id IS NULL THEN upper(regexp_extract(model, '^[^ ]+')[1]) || lower(regexp_extract(model, '^[^ ]+')[2:]) END AS brand FROM asked LEFT JOIN stored s USING (model, category)""")
def products_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    stored = part.filter("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("model")).agg(F.min("p_partkey").cast("string").alias("id")).withColumn("category", F.lit("smartphone"))
    new, every = fleet.products_for(stored, part.select(F.col("p_name").alias("model"), F.when(F.col("p_size") % 2 == 0, "smartphone").otherwise(CAR).alias("category")))
    return every.join(new.select("model", "category", "brand", F.lit(True).alias("is_new")), ["model", "category"], "left").select("model", "category", "product_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), "brand")


# Merging two instances

_SIDES = """our_targets AS (SELECT 'o' || n_nationkey AS id, 'smartphone' AS category, n_name AS query FROM nation WHERE n_nationkey < 18), their_targets AS (SELECT 't' || n_nationkey AS id, 'smartphone' AS category, n_name AS query FROM nation WHERE n_nationkey >= 5),
sold AS (SELECT o_orderkey AS k, 'https://market.example/' || o_orderkey AS listing_url, o_totalprice AS price, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
our_listings AS (SELECT CASE WHEN k % 10 = 0 THEN 'x' || (k + 3) ELSE 'o' || k END AS id, listing_url, price FROM sold WHERE k % 2 = 0),
their_listings AS (SELECT 'x' || k AS id, listing_url, price, CASE WHEN k % 11 <> 0 THEN 't' || nation END AS target_id FROM sold WHERE k % 3 = 0),
mapping AS (SELECT t.id AS their_id, coalesce(o.id, t.id) AS our_id, o.id IS NULL AS is_new FROM their_targets t LEFT JOIN our_targets o USING (category, query)),
mapped AS (SELECT l.id, listing_url, price, m.our_id AS target_id FROM their_listings l LEFT JOIN mapping m ON l.target_id = m.their_id WHERE l.target_id IS NULL OR m.our_id IS NOT NULL),
fresh AS (SELECT * FROM mapped WHERE listing_url NOT IN (SELECT listing_url FROM our_listings)), added AS (SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM our_listings)),
their_history AS (SELECT DISTINCT l_linenumber || '-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, 'x' || l_orderkey AS listing_id, l_extendedprice AS new_price FROM lineitem),
events_in AS (SELECT * FROM their_history WHERE listing_id IN (SELECT id FROM (SELECT id FROM added UNION SELECT id FROM our_listings) WHERE id IN (SELECT id FROM mapped)) AND id NOT IN (SELECT id FROM their_history WHERE id LIKE '1-%'))"""


def _sides(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    nation, lines = table(spark, d, "nation"), table(spark, d, "lineitem")
    target = lambda prefix, which: nation.filter(which).select(F.concat(F.lit(prefix), "n_nationkey").alias("id"), F.lit("smartphone").alias("category"), F.col("n_name").alias("query"))
    k = F.col("o_orderkey")
    sold = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(k, F.concat(F.lit("https://market.example/"), k).alias("listing_url"), F.col("o_totalprice").alias("price"), F.col("c_nationkey").alias("nation"))
    ours = sold.filter(k % 2 == 0).select(F.when(k % 10 == 0, F.concat(F.lit("x"), k + 3)).otherwise(F.concat(F.lit("o"), k)).alias("id"), "listing_url", "price", F.concat(F.lit("o"), "nation").alias("target_id"), F.lit("ours").alias("note"))
    theirs = sold.filter(k % 3 == 0).select(F.concat(F.lit("x"), k).alias("id"), "listing_url", "price", F.when(k % 11 != 0, F.concat(F.lit("t"), "nation")).alias("target_id"), F.lit(1).alias("extra"))
    history = lines.select(F.concat_ws("-", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("x"), "l_orderkey").alias("listing_id"), F.col("l_extendedprice").alias("new_price")).distinct()
    return {"targets": target("o", "n_nationkey < 18"), "listings": ours, "history": history.filter("id LIKE '1-%'")}, {"targets": target("t", "n_nationkey >= 5"), "listings": theirs, "history": history}


@query(f"WITH {_SIDES} SELECT * FROM added")
def merge_listings(spark: SparkSession, d: str) -> DataFrame:
    return merging.plan_merge(*_sides(spark, d)).added["listings"]


@query(f"WITH {_SIDES} SELECT id, listing_url, 'unknown target' AS reason FROM their_listings WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM their_targets) UNION ALL SELECT id, listing_url, 'id in use' FROM fresh WHERE id IN (SELECT id FROM our_listings)")
def merge_left_out(spark: SparkSession, d: str) -> DataFrame:
    return merging.plan_merge(*_sides(spark, d)).left_out


@query(f"WITH {_SIDES} SELECT * FROM events_in")
def merge_history(spark: SparkSession, d: str) -> DataFrame:
    return merging.plan_merge(*_sides(spark, d)).added["history"]


@query(f"""WITH {_SIDES} SELECT 'targets' AS "table", (SELECT count(*) FROM their_targets) AS candidates, (SELECT count(*) FROM mapping WHERE is_new) AS added
UNION ALL SELECT 'listings', (SELECT count(*) FROM mapped), (SELECT count(*) FROM added) UNION ALL SELECT 'history', (SELECT count(*) FROM their_history), (SELECT count(*) FROM events_in)""")
def merge_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return merging.plan_merge(*_sides(spark, d)).counts()


# Landed pages, backfills and the nightly job

_ADS = f"""{O.LISTINGS}, ads AS (SELECT id, variant_key AS target, category, floor(price)::DOUBLE AS price, tier, found_at, model, split_part(variant_key, '-', 2) AS nation, storage_gb, 'https://market.example/annunci/a-' || id || '.htm' AS url,
  row_number() OVER (PARTITION BY variant_key ORDER BY found_at DESC, id) - 1 AS nth FROM listings)"""


@query(f"WITH {_ADS} SELECT target, (nth // 50 * 50)::INTEGER AS start, (nth % 50)::INTEGER AS place, url, price, found_at AS published FROM ads WHERE price >= 20000 AND price < 300000 AND found_at >= TIMESTAMP '1994-01-01' AND target <> 'MACHINERY-5'")
def landed_backfill(spark: SparkSession, d: str) -> DataFrame:
    found = paged.scan(spark, A.landing(spark, d), pages_per_task=2)
    wanted = found.filter((F.col("price") >= 20000) & (F.col("price") < 300000) & (F.col("published") >= F.lit("1994-01-01 00:00:00").cast("timestamp")) & (F.col("target") != "MACHINERY-5"))
    return wanted.select("target", "start", "place", "url", "price", "published")


@query(f"WITH {_ADS}, admitted AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY nth) AS turn FROM ads WHERE price BETWEEN 50000 AND 200000) SELECT target, url, price FROM admitted WHERE turn <= 20")
def landed_quota(spark: SparkSession, d: str) -> DataFrame:
    return paged.scan(spark, A.landing(spark, d), quota=20, min_price=50000, max_price=200000).select("target", "url", "price")


@query(f"""WITH {_ADS}, {TARGETS}, found AS (SELECT a.target, a.id, a.price FROM ads a JOIN targets t ON a.target = t.id WHERE is_active AND t.query ILIKE '%build%' AND nth < 500 AND a.price >= 50),
stored AS (SELECT o_orderkey AS id, o_totalprice * 1.2::DOUBLE AS price FROM orders WHERE o_orderkey % 3 <> 0)
SELECT target, count(*) AS scraped, count(*) FILTER (WHERE s.id IS NULL) AS new, count(s.id) AS updated, count(*) FILTER (WHERE f.price < s.price) AS price_drops FROM found f LEFT JOIN stored s USING (id) GROUP BY target""")
def backfill_totals(spark: SparkSession, d: str) -> DataFrame:
    chosen = backfill.backfill_fleet(A.targets(spark, d), "smartphone", "BUILD").select(F.col("id").alias("target"))
    found = paged.scan(spark, A.landing(spark, d), max_pages=backfill.MAX_PAGES).join(chosen, "target", "left_semi")
    stored = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("https://market.example/annunci/a-"), "o_orderkey", F.lit(".htm")).alias("listing_url"), (F.col("o_totalprice") * 1.2).alias("price"))
    return backfill.backfill_totals(backfill.admitted(found.withColumnRenamed("url", "listing_url"), "smartphone"), stored)


_NIGHT = f"""{_ADS}, {TARGETS}, judged AS (SELECT a.*, t.nation AS n, t.nation = 7 OR t.nation = 11 AS failed FROM ads a JOIN targets t ON a.target = t.id WHERE is_active),
taken AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY nth) AS turn FROM judged WHERE NOT failed AND CASE WHEN category = 'automobile' THEN price BETWEEN 1000 AND 200000 ELSE price >= 50 END
  AND CASE n WHEN 3 THEN year(found_at) BETWEEN 1995 AND 1997 WHEN 4 THEN category = 'automobile' OR (id % 2 = 0 AND storage_gb = 128) ELSE id % 9 <> 0 OR (id % 2 = 0 AND storage_gb::VARCHAR = nation) END AND NOT (category <> 'automobile' AND id % 10 = 0)),
chosen AS (SELECT *, tier = 'rotto' AS wreck FROM taken WHERE turn <= 50),
counts AS (SELECT target, count(*) AS scraped, count(*) FILTER (WHERE NOT wreck) AS considered, count(*) FILTER (WHERE wreck) AS excluded FROM chosen GROUP BY target), {O.fenced("(SELECT * FROM chosen WHERE NOT wreck)", "target", "inside", 1)},
results AS (SELECT t.id AS target_id, t.query, CASE t.nation WHEN 7 THEN 'filters' WHEN 11 THEN 'page' END AS error, CASE WHEN t.nation NOT IN (7, 11) THEN coalesce(scraped, 0) END AS scraped, CASE WHEN t.nation NOT IN (7, 11) THEN coalesce(considered, 0) END AS considered,
  CASE WHEN t.nation NOT IN (7, 11) THEN coalesce(excluded, 0) END AS excluded, round({O.mean("p")}, 2) AS avg_price, p[1] AS min_price, p[len(p)] AS max_price, len(p)::BIGINT AS volume
  FROM targets t LEFT JOIN counts c ON t.id = c.target LEFT JOIN inside i ON t.id = i.target WHERE is_active)"""


def _night(spark: SparkSession, d: str) -> nightly.Night:
    products = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("model"), F.lit("smartphone").alias("category"))
    return nightly.run_night(A.targets(spark, d), A.pages(spark, d, broken=True), products, F.lit("2001-08-01").cast("date"))


@query(f"WITH {_NIGHT} SELECT * FROM results")
def nightly_results(spark: SparkSession, d: str) -> DataFrame:
    return _night(spark, d).results.drop("category", "product_id")


@query(f"""WITH {_NIGHT} SELECT id AS target_id, 'filters' AS input, '{{"min_year": ' AS text FROM targets WHERE nation = 7 AND is_active UNION ALL SELECT id, 'page', NULL FROM targets WHERE nation = 11 AND is_active AND id IN (SELECT target FROM ads)""")
def nightly_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _night(spark, d).quarantine.select("target_id", "input", F.when(F.col("input") == "filters", F.col("text")).alias("text"))


_OLD = f"""{_ADS}, {TARGETS}, {PHONES}, old AS (SELECT id, number, line, storage_gb, 'smartphone' AS category, variant_key AS right_key, CASE WHEN id % 3 = 0 THEN 'iphone-old' ELSE variant_key END AS variant_key, CASE WHEN id % 4 = 0 THEN 'rotto' ELSE 'buono' END AS tier, CASE WHEN id % 5 = 0 THEN 'Verde' END AS color,
  CASE WHEN id % 2 = 0 THEN 'Rosso' END AS said FROM phones)"""


@query(f"WITH {_OLD}, now AS (SELECT id, right_key AS variant_key, 'buono' AS tier, coalesce(said, color) AS color, variant_key AS k, tier AS t, color AS c FROM old) SELECT id, variant_key, tier, color FROM now WHERE variant_key <> k OR tier <> t OR color IS DISTINCT FROM c")
def variant_backfill(spark: SparkSession, d: str) -> DataFrame:
    i, none = F.col("id"), F.array().cast("array<string>")
    stored = A.phones(spark, d).withColumns({
        "title": F.when(i % 2 == 0, F.concat("title", F.lit(" product red"))).otherwise(F.col("title")), "variant_key": F.when(i % 3 == 0, "iphone-old").otherwise(F.col("variant_key")), "tier": F.when(i % 4 == 0, "rotto").otherwise("buono"),
        "color": F.when(i % 5 == 0, "Verde"), "target_id": F.lit(None).cast("string"), "defects_noted": none, "features": none,
    })
    return backfill.variant_changes(stored, A.targets(spark, d)).select("id", "variant_key", "tier", "color")


# What readers see


@query(f"""WITH {O.SALES}, {PHONES}, named AS (SELECT DISTINCT model, number, line FROM phones), aged AS (SELECT id, variant_key, (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(found_at)) // 1000000 AS s, (id % 90) - 20 AS pct FROM sales)
SELECT id::VARCHAR AS key, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS label, CASE WHEN id % 7 = 0 THEN 'n/d' WHEN pct >= 20 THEN 'Alto margine' WHEN pct < 0 THEN 'Sotto media' ELSE 'Margine medio' END AS margin,
CASE WHEN id % 7 = 0 THEN NULL WHEN pct >= 70 THEN 'high' WHEN pct >= 45 THEN 'fair' ELSE 'low' END AS score FROM aged
UNION ALL SELECT model, replace({_NAME("number")}, ' mini', ' Mini'), NULL, NULL FROM named""")
def labels_and_tiers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    percent = F.when(i % 7 != 0, i % 90 - 20)
    aged = A.listings(spark, d).select(i.cast("string").alias("key"), labels.relative_time(F.col("found_at"), F.lit("1998-08-02").cast("timestamp")).alias("label"), labels.margin_tier(percent).alias("margin"), labels.score_tier(percent).alias("score"))
    none = F.lit(None).cast("string")
    return aged.unionByName(A.phones(spark, d).select("model").distinct().select(F.col("model").alias("key"), labels.model_label(F.col("model")).alias("label"), none.alias("margin"), none.alias("score")))


@query(f"""WITH {O.SALES} SELECT id, CASE WHEN id % 2 = 0 THEN 'T' ELSE 'Bella Bici 12' END AS title, price AS "askingPrice", tier AS "conditionTier", storage_gb AS "storageGb", strftime(found_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "foundAt",
strftime(sold_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS sold, greatest(0, floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(found_at)) / 86400000000::DOUBLE))::BIGINT AS "daysOnline", (price::DECIMAL(18, 2))::DOUBLE AS money, 0 AS images FROM sales""")
def listing_view_as_json(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = A.listings(spark, d, sales=True).withColumns({"title": F.when(i % 2 == 0, "T"), "listing_url": F.concat(F.lit("https://market.example/x/bella-bici-12-"), i, F.lit(".htm"))})
    view = labels.listing_view(rows, A.as_of()).join(rows.select("id", F.col("sold_at").alias("sold"), F.col("price").cast("decimal(18,2)").alias("money")), "id")
    return labels.json_values(view).select("id", "title", "askingPrice", "conditionTier", "storageGb", "foundAt", "sold", "daysOnline", "money", F.size("images").alias("images"))


_RANKED = f"""WITH {O.SALES}, boxes AS (SELECT model, count(*) AS volume, median(price) AS median_price FROM sales WHERE {O.ACTIVE} AND price > 0 GROUP BY model),
priced AS (SELECT model, volume, median_price, CASE WHEN model LIKE 'M%' THEN 0 WHEN model LIKE 'B%' THEN NULL ELSE volume % 7 + 0.5::DOUBLE END AS roi_per_day, CASE WHEN model LIKE 'A%' THEN 0 ELSE (volume % 11)::DOUBLE END AS opportunity, CASE WHEN model LIKE 'H%' THEN 1.5::DOUBLE END AS change_pct FROM boxes),
ranked AS (SELECT *, row_number() OVER (ORDER BY coalesce(nullif(roi_per_day, 0), -1) DESC, coalesce(nullif(opportunity, 0), -1) DESC, volume DESC, model)::INTEGER AS rank FROM priced)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    active = A.listings(spark, d).filter(market.is_active(F.col("status")) & (F.col("price") > 0))
    boxes = active.groupBy("model").agg(F.count("*").alias("volume"), F.median("price").alias("median_price"))
    first = F.substring("model", 1, 1)
    priced = boxes.withColumns({"roi_per_day": F.when(first == "M", 0.0).when(first != "B", F.col("volume") % 7 + 0.5), "opportunity": F.when(first == "A", 0.0).otherwise((F.col("volume") % 11).cast("double")), "change_pct": F.when(first == "H", 1.5)})
    return labels.ranked_models(priced)


@query(f"{_RANKED} SELECT model, volume, rank FROM ranked")
def models_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("model", "volume", "rank")


@query(f"""{_RANKED} SELECT round_even(avg(median_price), 0)::BIGINT AS avg_market_price, (SELECT CASE WHEN coalesce(opportunity, 0) <> 0 THEN model END FROM ranked WHERE rank = 1) AS top_opportunity,
(SELECT model FROM ranked WHERE change_pct IS NOT NULL ORDER BY rank LIMIT 1) AS trend_model, count(*) AS models FROM ranked""")
def market_headline(spark: SparkSession, d: str) -> DataFrame:
    return labels.headline(_ranked(spark, d))


@query(f"""WITH {_ADS} SELECT url AS listing_url, price, year(found_at)::INTEGER AS ad_year, CASE WHEN category <> 'automobile' AND id % 10 = 0 THEN 'cover-' ELSE '' END || lower(model) || CASE WHEN id % 9 <> 0 THEN '-' || nation ELSE '' END || CASE WHEN id % 2 = 0 THEN '-' || storage_gb || '-gb' ELSE '' END AS slug,
id::VARCHAR AS number, 'A' AS url_title FROM ads""")
def ad_features(spark: SparkSession, d: str) -> DataFrame:
    """Prices, years, slugs, ids and titles of urls, from the pages as they landed."""
    from tallymart.sources.ads import PAGE, ads_of

    opened = A.pages(spark, d).select(F.from_json("page", PAGE).alias("p")).select("p.*")
    url = F.col("listing_url")
    return ads_of(opened).select("listing_url", "price", "ad_year", T.slug(F.col("title")).alias("slug"), T.id_of_url(url).alias("number"), T.title_of_url(url).alias("url_title"))


_SAID = """said AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Batteria al ' || o_orderkey % 130 || '%' WHEN 1 THEN o_orderkey % 130 || '% di batteria, schermo integro' WHEN 2 THEN 'km ' || o_orderkey % 90 + 10 || '.500 del ' || 1970 + o_orderkey % 60
  WHEN 3 THEN 'percorsi ' || o_orderkey % 200 + 3 || ' mila km' WHEN 4 THEN o_orderkey % 70 + 10 || '000 km, anno ' || 1985 + o_orderkey % 50 ELSE 'codice x' || o_orderkey || 'z, 1 tb' END AS t FROM orders)"""


@query(f"""WITH {_SAID}, n AS (SELECT *, id % 130 AS b FROM said)
SELECT id, CASE WHEN id % 6 IN (0, 1) AND b BETWEEN 50 AND 100 THEN b END::INTEGER AS battery_pct, CASE id % 6 WHEN 2 THEN (id % 90 + 10) * 1000 + 500 WHEN 3 THEN CASE WHEN id % 200 + 3 >= 10 THEN (id % 200 + 3) * 1000 END WHEN 4 THEN (id % 70 + 10) * 1000 END::INTEGER AS km,
CASE WHEN id % 6 = 2 AND 1970 + id % 60 >= 1980 THEN 1970 + id % 60 WHEN id % 6 = 4 THEN CASE WHEN 1985 + id % 50 < 2030 THEN 1985 + id % 50 END END::INTEGER AS year, CASE WHEN id % 6 = 5 THEN 1024 END::INTEGER AS storage_gb FROM n""")
def battery_and_kilometres(spark: SparkSession, d: str) -> DataFrame:
    """Battery, kilometres, years and storage from texts that say them in several ways."""
    i = F.col("o_orderkey")
    say = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    text = F.when(i % 6 == 0, say("Batteria al ", i % 130, "%")).when(i % 6 == 1, say(i % 130, "% di batteria, schermo integro")).when(i % 6 == 2, say("km ", i % 90 + 10, ".500 del ", 1970 + i % 60))
    text = text.when(i % 6 == 3, say("percorsi ", i % 200 + 3, " mila km")).when(i % 6 == 4, say(i % 70 + 10, "000 km, anno ", 1985 + i % 50)).otherwise(say("codice x", i, "z, 1 tb"))
    t = F.col("t")
    return table(spark, d, "orders").select(i.alias("id"), text.alias("t")).select("id", T.battery_pct(t).alias("battery_pct"), T.kilometres(t).alias("km"), T.year(t).alias("year"), T.storage_gb(t).alias("storage_gb"))


@query(f"""WITH {O.RUNS}, moved AS (SELECT *, lag(status) OVER (PARTITION BY category ORDER BY ran_at, id) AS before FROM judged),
told AS (SELECT *, CASE WHEN status = 'down' AND before IS DISTINCT FROM 'down' THEN 'went_down' WHEN status <> 'down' AND before = 'down' THEN 'recovered' END AS transition FROM moved)
SELECT id, category, transition, '-100' AS chat, CASE transition WHEN 'went_down' THEN '🔴 <b>Scraper DOWN</b> (' || category || ')' || chr(10) || failed || '/' || targets || ' target falliti, ' || scraped || ' annunci raccolti.' || chr(10) || 'Probabile blocco Akamai o proxy KO — controlla.'
ELSE '🟢 <b>Scraper ripristinato</b> (' || category || ') — ' || scraped || ' annunci nell''ultimo giro.' END AS text FROM told WHERE transition IS NOT NULL""")
def health_alerts(spark: SparkSession, d: str) -> DataFrame:
    runs = A.runs(spark, d)
    judged = runs.withColumn("status", history.run_status(F.col("targets"), F.col("ok"), F.col("failed"), F.col("scraped")))
    return alerts.ops_alerts(history.health_transitions(judged), {"ops": None, "tech": "-100", "auto": "-200"})


# Streams


@query("""WITH rounds AS (SELECT o_orderkey AS id, r, o_totalprice * CASE (o_orderkey + r) % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS price, TIMESTAMP '2026-01-01' + r * INTERVAL 1 DAY AS seen FROM orders, range(4) t(r) WHERE o_orderkey % 3 <> r),
placed AS (SELECT *, row_number() OVER w AS nth, min(price) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest, min(seen) OVER (PARTITION BY id) AS found FROM rounds WINDOW w AS (PARTITION BY id ORDER BY r)),
kept AS (SELECT id, min(price) AS price, min(seen) AS found FROM rounds GROUP BY id)
SELECT id::VARCHAR AS id, CASE WHEN nth = 1 THEN 'new' ELSE 'drop' END AS change, CASE WHEN nth > 1 THEN lowest END AS old_price, price AS new_price, NULL::DOUBLE AS days FROM placed WHERE nth = 1 OR price < lowest
UNION ALL SELECT id::VARCHAR, 'sold', price, NULL, (epoch(TIMESTAMP '2026-01-09') - epoch(found)) / 86400 FROM kept WHERE id % 10 = 0""")
def listing_changes(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds of prices and one of probes, as a stream with keyed state."""
    from tallymart.staging import scratch
    from tallymart.streaming import changes

    orders, key, start = table(spark, d, "orders"), F.col("o_orderkey"), F.lit("2026-01-01").cast("timestamp")
    url = F.concat(F.lit("https://market.example/a-"), key, F.lit(".htm"))
    ads, probes = scratch(spark, "ads"), scratch(spark, "probes")
    for r in range(4):
        factor = F.when((key + r) % 5 == 0, 0.9).when((key + r) % 5 == 1, 1.1).otherwise(1.0)
        seen = orders.filter(key % 3 != r).select(url.alias("listing_url"), (F.col("o_totalprice") * factor).alias("price"), (start + F.expr(f"INTERVAL {r} DAYS")).alias("at"))
        seen.write.parquet(f"{ads}/round={r}")
    gone = orders.select(url.alias("listing_url"), F.when(key % 10 == 0, 404).otherwise(200).alias("status_code"), url.alias("final_url"), F.lit(None).cast("string").alias("error"), F.lit("2026-01-09").cast("timestamp").alias("at"))
    gone.write.mode("overwrite").parquet(probes)
    stream = spark.readStream.schema("listing_url string, price double, at timestamp").parquet(f"{ads}/round=*")
    probed = spark.readStream.schema("listing_url string, status_code int, final_url string, error string, at timestamp").parquet(probes)
    out = scratch(spark, "changes")
    changes.run_to_files(changes.listing_changes(stream, probed), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    found = spark.read.schema(changes.CHANGES).parquet(f"{out}/rows")
    return found.select(T.id_of_url(F.col("listing_url")).alias("id"), "change", "old_price", "new_price", "days")
