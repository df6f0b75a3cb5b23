"""Landed pages of raw ads, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.functions import text as T

AD = (
    "struct<subject:string, body:string, urls:struct<`default`:string>, features:array<struct<uri:string, `values`:array<struct<key:string, value:string>>>>, "
    "images:array<struct<cdn_base_url:string>>, geo:struct<town:struct<value:string>, city:struct<value:string>>, advertiser:struct<user_id:string, company:boolean, shop_id:string>>"
)
PAGE = f"ads array<{AD}>, count_all bigint"


def read_pages(spark: SparkSession, folder: str, stream: bool = False, files_per_batch: int = 100) -> DataFrame:
    """Pages of JSON, one document a file; as a stream in the order in which they land."""
    if stream:
        return spark.readStream.schema(PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return spark.read.schema(PAGE).option("multiLine", True).json(folder)


def ads_of(pages: DataFrame) -> DataFrame:
    """One row an ad: url, title, description, price, images, location, seller and the attributes of its feature list."""
    return _parsed(pages.select(F.explode("ads").alias("ad")).select("ad.*"))


def ads_of_page_rows(rows: DataFrame, *carried: str) -> DataFrame:
    """The same of rows with an ad each as ``ad``, with columns of theirs besides."""
    return _parsed(rows.select(*carried, "ad.*"), *carried)


def ads_of_scan(scan: DataFrame, *carried: str) -> DataFrame:
    """The same of ads that the paged source read as text, with columns of the scan besides."""
    return ads_of_page_rows(scan.select(*carried, F.from_json("ad", AD).alias("ad")), *carried)


def _parsed(ad: DataFrame, *carried: str) -> DataFrame:
    value = lambda uri: T.json_value(F.col("features"), uri)
    dealer = F.coalesce(F.col("advertiser.company"), F.lit(False)) | (F.coalesce(F.col("advertiser.shop_id"), F.lit("")) != "")
    return ad.select(
        *carried, F.col("urls")["default"].alias("listing_url"), F.col("subject").alias("title"), F.col("body").alias("description"), T.whole_price(value("/price")).cast("double").alias("price"),
        F.transform("images", lambda i: i["cdn_base_url"]).alias("image_urls"), F.coalesce(F.col("geo.town.value"), F.col("geo.city.value")).alias("location"),
        F.col("advertiser.user_id").alias("seller_id"), F.when(dealer, "dealer").otherwise("privato").alias("seller_type"),
        T.digits(value("/year")).alias("ad_year"), T.digits(value("/mileage_scalar")).alias("ad_km"), value("/gearbox").alias("transmission"), value("/fuel").alias("fuel"),
    ).filter(F.col("listing_url").isNotNull())
