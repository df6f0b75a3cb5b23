"""What phones lose with age: prices of one line and storage, generation by generation, on two release calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.operators import pools
from tallymart.params import DEFAULTS, Params

# How variants are written, lines with their labels, and the longest gap between generations.
VARIANT = r"^iphone-(\d+)(e)?(?:-(mini|plus|air|pro-max|pro))?-(\d+|na)$"
LINES = {"": "Base", "mini": "mini", "plus": "Plus", "air": "Air", "pro": "Pro", "pro-max": "Pro Max", "e": "e"}
MOST_YEARS = 3.0

_SERIES = ["line", "storage", "merged"]


def parsed_variant(variant: Column) -> Column:
    """(number, line, storage) of a phone's variant, storage null for ``na``; null for other variants."""
    part = lambda i: F.regexp_extract(variant, VARIANT, i)
    line = F.when(part(2) != "", "e").otherwise(part(3))
    return F.when(variant.rlike(VARIANT), F.struct(part(1).try_cast("int").alias("number"), line.alias("line"), part(4).try_cast("int").alias("storage")))


def released(number: Column, line: Column) -> Column:
    """September of 2008 + number; the e line follows in February of the next year."""
    return F.when(line == "e", F.make_date(F.lit(2009) + number, F.lit(2), F.lit(1))).otherwise(F.make_date(F.lit(2008) + number, F.lit(9), F.lit(1)))


def line_label(line: Column) -> Column:
    out = line
    for name, label in LINES.items():
        out = F.when(line == name, label).otherwise(out)
    return out


def storage_label(storage: Column, missing: str = "tutte") -> Column:
    """``1TB`` from 1024 on; ``missing`` (another reader says ``memoria n/d``) for none."""
    return F.when(storage.isNull(), missing).when(storage >= 1024, "1TB").otherwise(F.concat(storage.cast("string"), F.lit("GB")))


def model_key(number: Column, line: Column) -> Column:
    base = F.concat(F.lit("iphone-"), number.cast("string"))
    return F.when(line == "e", F.concat(base, F.lit("e"))).when(line == "", base).otherwise(F.concat_ws("-", base, line))


def model_name(number: Column, line: Column) -> Column:
    base = F.concat(F.lit("iPhone "), number.cast("string"))
    return F.when(line == "e", F.concat(base, F.lit("e"))).when(line == "", base).otherwise(F.concat_ws(" ", base, line_label(line)))


def generation_medians(variants: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(line, storage, merged, number, median, sample) from the pools of variants (``variant_key``, ``price``, ``n``).

    One pass over counted prices with two grouping sets: by storage, and, to
    fall back on, over all storages of a line (``merged``, storage null), which
    also has the variants whose storage is not known.
    """
    parsed = variants.select(parsed_variant(F.col("variant_key")).alias("v"), "price", "n").select("v.*", "price", "n").filter(F.col("number").isNotNull())
    fine, coarse = ["line", "storage", "number", "price"], ["line", "number", "price"]
    levels = parsed.groupingSets([[F.col(c) for c in fine], [F.col(c) for c in coarse]], *[F.col(c) for c in fine]).agg(F.sum("n").alias("n"), F.grouping("storage").cast("boolean").alias("merged"))
    known = levels.filter(F.col("merged") | F.col("storage").isNotNull())
    keys = [*_SERIES, "number"]
    medians = pools.per_pool(pools.ranked(known, keys, params.pool_min), keys, pools.median().alias("median"))
    return medians.select(*keys, F.bround("median").cast("long").alias("median"), F.col("n").alias("sample"))


def points(variants: DataFrame, today: Column, params: Params = DEFAULTS) -> DataFrame:
    """One row a generation of each series of two or more, with what it loses in a year against the next older one.

    The next older generation of a series is the price of the same phone later
    on; it counts where its release is at most ``MOST_YEARS`` away, else there
    is no loss. Only medians are ordered, a row for each generation.
    """
    series = Window.partitionBy(*_SERIES)
    newest_first = series.orderBy(F.desc("number"))
    out = generation_medians(variants, params).withColumns({
        "generations": F.count("*").over(series), "newest": F.first("median").over(newest_first),
        "older_number": F.lead("number").over(newest_first), "older_median": F.lead("median").over(newest_first),
    }).filter(F.col("generations") >= 2)
    out = out.withColumn("released_at", released(F.col("number"), F.col("line")))
    gap = F.bround(F.datediff("released_at", released(F.col("older_number"), F.col("line"))) / 365.25, 1)
    near = (gap > 0) & (gap <= MOST_YEARS) & (F.col("median") > 0)
    out = out.withColumn("loss_year_eur", F.when(near, F.bround((F.col("median") - F.col("older_median")) / gap)).cast("long"))
    key = model_key(F.col("number"), F.col("line"))
    return out.select(
        "line", "storage", "merged", "number", key.alias("model_key"), F.when(~F.col("merged"), F.concat_ws("-", key, F.col("storage").cast("string"))).alias("variant_key"), model_name(F.col("number"), F.col("line")).alias("model"),
        line_label(F.col("line")).alias("line_label"), storage_label(F.col("storage")).alias("storage_label"), "released_at", F.bround(F.datediff(today, "released_at") / 365.25, 2).alias("age_years"), "median", "sample",
        F.when(F.col("newest") != 0, F.bround(F.col("median") / F.col("newest") * 100, 1)).alias("retention_pct"), "loss_year_eur", F.bround(F.col("loss_year_eur") / F.col("median") * 100, 1).alias("loss_year_pct"),
        F.bround(F.col("loss_year_eur") / 12).cast("long").alias("loss_month_eur"), F.when(near, model_name(F.col("older_number"), F.col("line"))).alias("vs_model"),
    )


def ordered_series(found: DataFrame) -> DataFrame:
    """Points by line and storage (all storages first), newest generation first."""
    return found.orderBy("line", F.coalesce("storage", F.lit(0)), F.desc("number"))


def ordered_models(found: DataFrame) -> DataFrame:
    """Points of single storages, the highest loss first; those without a loss count as -1."""
    return found.filter(~F.col("merged")).orderBy(F.coalesce("loss_year_pct", F.lit(-1.0)).desc(), "line", "storage", F.desc("number"))


def curves(found: DataFrame) -> DataFrame:
    """One row a series: its sample and its points, newest first."""
    point = F.struct((-F.col("number")).alias("turn"), "model_key", "age_years", "median", "retention_pct", "loss_year_eur")
    listed = F.transform(F.sort_array(F.collect_list(point)), lambda p: p.dropFields("turn"))
    return found.groupBy("line", "storage", "merged", "line_label", "storage_label").agg(F.sum("sample").alias("sample"), listed.alias("points"))


def carry_costs(found: DataFrame) -> DataFrame:
    """``(variant_key, carry_month)``: what a month in stock costs, where it is not 0."""
    return found.filter(~F.col("merged") & (F.col("loss_month_eur") != 0)).select("variant_key", F.col("loss_month_eur").alias("carry_month"))


def summary(found: DataFrame) -> DataFrame:
    """The single storage that loses least, the one that loses most, and the mean loss in percent; one row."""
    rated = found.filter(~F.col("merged") & F.col("loss_year_pct").isNotNull())
    turn = [F.col("line").alias("l"), F.col("storage").alias("s"), (-F.col("number")).alias("n")]
    what = F.struct("model", "storage_label", "loss_year_pct")
    best, worst = F.min_by(what, F.struct("loss_year_pct", *turn)), F.min_by(what, F.struct((-F.col("loss_year_pct")).alias("p"), *turn))
    out = rated.agg(best.alias("best"), worst.alias("worst"), F.sum(F.col("loss_year_pct").cast("decimal(18,1)")).cast("double").alias("total"), F.count("*").alias("rated"))
    flat = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("best", "worst") for name in ("model", "storage_label", "loss_year_pct")]
    return out.select(*flat, F.bround(F.try_divide("total", "rated"), 1).alias("mean_loss_pct"), "rated")
