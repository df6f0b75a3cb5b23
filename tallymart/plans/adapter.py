"""The driver's star-schema tables seen as listings, price changes, deals and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymart.operators.depreciation import model_key, model_name
from tallymart.operators.listings import variant_key
from tallymart.params import CAR, PHONE
from tallymart.sources import table
from tallymart.staging import scratch, stage

COLORS = ("Nero", "Bianco", "Blu", "Rosso", "Verde")
STORAGES = (64, 128, 256, 512)
STAGES = ("valutazione", "contattato", "offerta", "acquistato", "in_vendita", "venduto")


def as_of() -> Column:
    return F.lit("2001-08-01 00:00:00").cast("timestamp")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def listings(spark: SparkSession, d: str, sales: bool = False) -> DataFrame:
    """One listing an order; with ``sales`` the time at which a sold one went, its last shipment."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    if sales:  # joined first, while rows are narrow
        shipped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("timestamp").alias("shipped"))
        orders = orders.join(shipped, "o_orderkey", "left")
    digit, sold_at = F.substring("o_orderpriority", 1, 1), [F.when(F.col("o_orderstatus") == "F", F.col("shipped")).alias("sold_at")] if sales else []
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller_id"), F.col("c_mktsegment").alias("model"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("variant_key"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", CAR).otherwise(PHONE).alias("category"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") == "F", "venduto_rimosso").when(F.col("o_orderstatus") == "O", "nuovo").otherwise("visto").alias("status"),
        F.when(digit == "1", "come-nuovo").when(digit == "4", "difetti").when(digit == "5", "rotto").otherwise("buono").alias("tier"),
        F.col("o_orderdate").cast("timestamp").alias("found_at"), _pick(STORAGES, F.col("c_nationkey")).alias("storage_gb"), _pick(COLORS, F.col("c_nationkey")).alias("color"), *sold_at,
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """One price change a line item: from its price to its discounted price, in cents' precision."""
    new = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("new_price")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_extendedprice").alias("old_price"), new, F.col("l_shipdate").cast("timestamp").alias("changed_at"))


def deals(spark: SparkSession, d: str) -> DataFrame:
    """One deal an order with line items: bought for its discounted prices, with taxes as extra costs."""
    cost = F.struct(F.col("l_returnflag").alias("label"), (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)").cast("double").alias("amount"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("buy_price"), F.sort_array(F.collect_list(cost)).alias("extra_costs"), F.min("l_shipdate").cast("timestamp").alias("first_at"),
    )
    met = listings(spark, d).join(lines, F.col("id") == F.col("l_orderkey"))
    created = F.least("found_at", "first_at")
    return met.select(
        F.col("id"), _pick(STAGES, F.col("id")).alias("stage"), "buy_price", "extra_costs", F.col("price").alias("sell_price"), (F.col("price") * 1.25).alias("market_avg"), (F.col("price") * 0.01).alias("carry_month"),
        created.alias("created_at"), F.greatest("found_at", "first_at").alias("updated_at"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One scrape run an event, its counters from the value and the JSON property."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    out = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("ran_at"), k.alias("targets"), F.col("value"))
    out = out.withColumns({"failed": F.col("targets") % 4, "scraped": F.floor("value").cast("int")})
    return out.withColumns({"ok": F.greatest(F.lit(0), F.col("targets") - 10 * F.col("failed")), "new_count": F.col("scraped") % 7})


PHONE_LINES, PHONE_STORAGES = ("", "mini", "plus", "air", "pro", "pro-max", "e"), (64, 128, 256, 512, 1024, None)
TODAY = "2026-09-01"


def phones(spark: SparkSession, d: str) -> DataFrame:
    """One phone for sale an order with a seventh line: model and storage from the part, some storages unknown, one line with a long gap between generations; a stored table."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    first = F.min(F.struct("l_partkey", "l_extendedprice", "l_linestatus", "l_returnflag")).alias("first")
    lines = table(spark, d, "lineitem").filter("l_linenumber = 7").groupBy("l_orderkey").agg(first).select("l_orderkey", "first.*")
    key = F.col("p_partkey")
    out = lines.join(part, F.col("l_partkey") == key).withColumn("line", _pick(PHONE_LINES, F.floor(key / 7)))
    out = out.withColumns({"number": F.when(F.col("line") == "air", 11 + 5 * (key % 2)).otherwise(11 + key % 7), "storage_gb": _pick(PHONE_STORAGES, F.col("p_size"))})
    title = F.concat(model_name(F.col("number"), F.col("line")), F.when(F.col("storage_gb").isNull(), "").otherwise(F.concat(F.lit(" "), F.col("storage_gb").cast("string"), F.lit(" GB"))))
    none = F.lit(None)
    out = out.withColumn("title", title)
    return stage(out.select(
        F.col("l_orderkey").alias("id"), "title", F.lit(PHONE).alias("category"), F.col("storage_gb").cast("int").alias("storage_gb"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linestatus") == "O", "nuovo").otherwise("venduto_rimosso").alias("status"),
        F.when(F.col("l_returnflag") == "R", "rotto").when(F.col("l_returnflag") == "A", "come-nuovo").otherwise("buono").alias("tier"), model_key(F.col("number"), F.col("line")).alias("model"),
        variant_key(F.lit(PHONE), F.col("title"), F.col("storage_gb"), none.cast("string"), none.cast("int"), none.cast("int")).alias("variant_key"),
    ), "phones")


def replies(spark: SparkSession, d: str) -> DataFrame:
    """What a model could have written about listing ``id``: events' properties, broken JSON, and objects with values of many kinds."""
    i = F.col("event_id")
    parts = [piece for name, values in REPLY_VALUES.items() for piece in (F.lit(f', "{name}": '), _pick(values, F.floor(i / REPLY_EVERY[name])))]
    whole = F.concat(F.lit('{"motivo_prezzo": "'), F.col("event_type"), F.lit('"'), *parts, F.lit("}"))
    reply = F.when(i % 12 == 0, F.lit(None)).when(i % 12 == 1, "no json {").when(i % 12 == 2, "[1, 2]").when(i % 12 == 3, F.col("props")).otherwise(whole)
    return table(spark, d, "events").select(i.alias("id"), F.when(i % 5 == 0, CAR).otherwise(PHONE).alias("category"), reply.alias("reply"))


REPLY_VALUES = {
    "categoria_motivo": ('"Difetto "', '"legittimo"', '"SOSPETTO"', '"boh"', "null", "7"), "riparabile": ("true", '"Sì"', '"no"', "0", "1", "null", "[]", '"VERO"'), "rischio_truffa": ('"Alto"', '"medio "', "true"),
    "storage_gb": ('"256GB"', "1", '"1"', "128.0", "true", '"n/d"', "999", "null", '"64"'), "battery_pct": ('"91%"', "0", "100", '"101"', "87.9", "false"), "color": ('"Blu Sierra"', '"null"', '""', '"Ciano"', '"space BLACK"', "null"), "sintesi": ('""', '"ok"', "12", "false", "{}"),
}
REPLY_EVERY = {"categoria_motivo": 1, "riparabile": 2, "rischio_truffa": 3, "storage_gb": 5, "battery_pct": 7, "color": 11, "sintesi": 13}


def described(spark: SparkSession, d: str) -> DataFrame:
    """The phones with a description, gaps in storage, colour and battery, and no analysis yet but for some."""
    i = F.col("id")
    text = F.when(i % 4 == 0, F.lit(None).cast("string")).otherwise("in ottime condizioni")
    analysis = "struct<motivo_prezzo: string, categoria_motivo: string, riparabile: boolean, nota_riparazione: string, rischio_truffa: string, sintesi: string>"
    gone = F.when(i % 6 == 0, F.struct(F.lit("").alias("motivo_prezzo"), F.lit("difetto").alias("categoria_motivo"), (i % 12 == 0).alias("riparabile"), F.lit("").alias("nota_riparazione"), F.lit("alto").alias("rischio_truffa"), F.lit("").alias("sintesi"))).cast(analysis)
    return phones(spark, d).withColumns({"description": text, "color": F.when(i % 3 == 0, "Rosso").when(i % 3 == 1, ""), "battery_pct": F.when(i % 5 == 0, 80), "analysis": gone, "seller_type": F.when(i % 2 == 0, "privato").otherwise("finto_privato")})


def targets(spark: SparkSession, d: str) -> DataFrame:
    """One target for each nation and kind of customers, some with wishes, some with filters that are no JSON."""
    nation = F.col("c_nationkey")
    filters = F.when(nation == 7, '{"min_year": ').when(nation == 3, '{"min_year": 1995, "max_year": 1997}').when(nation == 4, '{"storage_gb": 128}').when(nation % 2 == 0, "{}")
    each = table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
    return each.select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("id"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", CAR).otherwise(PHONE).alias("category"), F.concat_ws(" ", F.initcap("c_mktsegment"), "c_nationkey").alias("query"),
        filters.alias("strict_filters"), (nation != 13).alias("is_active"),
    )


def ad_rows(spark: SparkSession, d: str) -> DataFrame:
    """What searches found: an ad an order, newest first in its target, with its page and place."""
    i = F.col("id")
    rows = listings(spark, d).select("id", F.col("variant_key").alias("target_id"), "model", "category", "price", "tier", "found_at", F.split_part("variant_key", F.lit("-"), F.lit(2)).alias("nation"), "storage_gb")
    nth = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("found_at"), "id")) - 1
    title = F.concat(F.when((i % 10 == 0) & (F.col("category") == PHONE), "Cover ").otherwise(""), F.col("model"), F.when(i % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.col("nation"))), F.when(i % 2 == 0, F.concat(F.lit(" "), F.col("storage_gb").cast("string"), F.lit(" gb"))).otherwise(""))
    pair = lambda uri, key, unit: F.struct(F.lit(uri).alias("uri"), F.array(F.struct(key.cast("string").alias("key"), F.concat(key.cast("string"), F.lit(unit)).alias("value"))).alias("values"))
    ad = F.struct(
        title.alias("subject"), F.when(F.col("tier") == "rotto", "schermo rotto").otherwise("").alias("body"), F.struct(F.concat(F.lit("https://market.example/annunci/a-"), i, F.lit(".htm")).alias("default")).alias("urls"), F.date_format("found_at", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.array(pair("/price", F.floor("price").cast("bigint"), ",00 €"), pair("/year", F.year("found_at"), "")).alias("features"),
    )
    found = F.count("*").over(Window.partitionBy("target_id"))
    return rows.withColumns({"nth": nth, "found": found, "ad": ad}).withColumn("start", (F.floor(F.col("nth") / PAGE_SIZE) * PAGE_SIZE).cast("int"))


PAGE_SIZE, PAGES_A_PACK = 50, 200


def _listed() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("nth", "ad"))), lambda x: x["ad"])


def pages(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    """The pages of ``ad_rows`` as JSON texts; with ``broken`` the first ones of a nation end too early."""
    out = ad_rows(spark, d).groupBy("target_id", "start").agg(_listed().alias("ads")).withColumn("page", F.to_json(F.struct("ads")))
    if broken:
        bad = F.col("target_id").endswith("-11") & (F.col("start") == 0)
        out = out.withColumn("page", F.when(bad, F.substring("page", 1, 100)).otherwise(F.col("page")))
    return out.select("target_id", "start", "page")


_LANDED: dict[tuple[str, str], str] = {}


def landing(spark: SparkSession, d: str) -> str:
    """A folder with one landed round of the pages, in packs as the paged source reads them; made once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LANDED:
        path, own = scratch(spark, "landing"), F.col("start")
        listed = ad_rows(spark, d).groupBy("target_id", "start", "found").agg(_listed().alias("ads"))
        nth = F.floor(own / (PAGE_SIZE * PAGES_A_PACK))
        count = F.least(F.lit(PAGES_A_PACK), F.ceil(F.col("found") / PAGE_SIZE) - nth * PAGES_A_PACK)
        first = nth * PAGE_SIZE * PAGES_A_PACK
        packed = listed.select(F.to_json(F.struct("start", "ads")).alias("value"), F.col("target_id").alias("target"), first.alias("start"), (first + (count - 1) * PAGE_SIZE).alias("last"), count.alias("pages"), own.alias("own"))
        folders = ["target", "start", "last", "pages"]  # a target's pages are in one task, as its ads were numbered there, and a pack is one file
        packed.sortWithinPartitions(*folders, "own").drop("own").write.mode("overwrite").partitionBy(*folders).text(f"{path}/round=0001")
        _LANDED[key] = path
    return _LANDED[key]
