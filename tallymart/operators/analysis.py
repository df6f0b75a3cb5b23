"""What a language model said of descriptions: parsed whatever it wrote, summed up, and put where values are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import text as T
from tallymart.operators.listings import variant_key
from tallymart.params import ACTIVE, PHONE

# What the fields may hold, and how long texts may be.
REASONS, NO_REASON = ("legittimo", "difetto", "sospetto", "nessuno"), "nessuno"
RISKS, LOW_RISK = ("basso", "medio", "alto"), "basso"
TRUE_WORDS = ("true", "vero", "si", "sì", "1")
STORAGES = (32, 64, 128, 256, 512, 1024)
TEXTS = {"motivo_prezzo": 300, "nota_riparazione": 200, "sintesi": 400}


FIELDS = ("motivo_prezzo", "categoria_motivo", "riparabile", "nota_riparazione", "rischio_truffa", "sintesi", "storage_gb", "color", "battery_pct")
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _text(name: str) -> Column:
    """A field of the reply as text, null where it is missing or JSON's null."""
    return F.col(f"__text_{name}")


def _kind(name: str) -> Column:
    """What it was: STRING, BOOLEAN, BIGINT and so on."""
    return F.col(f"__kind_{name}")


def _given(name: str) -> Column:
    """The text of a value that is not empty, 0, false, [] or {}."""
    value = _text(name)
    empty = value.isin("", "[]", "{}") | ((_kind(name) == "BOOLEAN") & (value == "false")) | (_kind(name).isin(*_NUMBERS) & (value.try_cast("double") == 0))
    return F.when(~empty, value)


def _one_of(name: str, allowed: tuple[str, ...], otherwise: str) -> Column:
    return F.coalesce(F.array_max(F.array_intersect(F.array(F.lower(F.trim(_text(name)))), F.array(*map(F.lit, allowed)))), F.lit(otherwise))


def _truth(name: str) -> Column:
    worded = F.lower(F.trim(_text(name))).isin(*TRUE_WORDS)
    return F.coalesce(F.when(_kind(name) == "STRING", worded).otherwise(_given(name).isNotNull()), F.lit(False))


def _whole(name: str) -> Column:
    """A number's whole part, a text that is a whole number, or else its first digits; true and false are no numbers."""
    number = _text(name).try_cast("double").cast("bigint")
    written = F.regexp_extract(_text(name), r"^\s*([+-]?\d+)\s*$", 1).try_cast("bigint")
    digits = F.regexp_extract(_text(name), r"\d+", 0).try_cast("bigint")
    return F.when(_kind(name).isin(*_NUMBERS), number).when(_kind(name) != "BOOLEAN", F.coalesce(written, digits))


def parse_replies(replies: DataFrame, raw: str = "reply", category: str = "category") -> tuple[DataFrame, DataFrame]:
    """Replies that are JSON objects, with ``analysis`` and ``fields``; and the others as they are, for a look.

    Enumerations fall back on their defaults, texts are cut, words for true are
    taken as true. ``fields`` (storage_gb, color, battery_pct) are for phones,
    each null where it is not plausible. Values that are arrays or objects
    count as their JSON. A reply that is null, no JSON or no object is bad.
    """
    parsed = replies.withColumn("__reply", F.try_parse_json(raw)).withColumn("__good", F.coalesce(F.startswith(F.schema_of_variant("__reply"), F.lit("OBJECT")), F.lit(False)))
    bad = parsed.filter(~F.col("__good")).select(*replies.columns)
    # Steps of their own, so that what many expressions use is computed once.
    at = lambda name, kind: F.try_variant_get("__reply", f"$.{name}", kind)
    texts = {f"__text_{n}": at(n, "string") for n in FIELDS} | {f"__kind_{n}": F.regexp_extract(F.schema_of_variant(at(n, "variant")), "^[A-Z]+", 0) for n in FIELDS}
    read = parsed.filter("__good").withColumns(texts)
    read = read.withColumns({"__storage": _whole("storage_gb"), "__battery": _whole("battery_pct"), "__color": F.lower(F.trim(_given("color")))})
    cut = lambda name: F.substring(F.coalesce(_given(name), F.lit("")), 1, TEXTS[name]).alias(name)
    analysis = F.struct(
        cut("motivo_prezzo"), _one_of("categoria_motivo", REASONS, NO_REASON).alias("categoria_motivo"), _truth("riparabile").alias("riparabile"), cut("nota_riparazione"), _one_of("rischio_truffa", RISKS, LOW_RISK).alias("rischio_truffa"), cut("sintesi"),
    )
    storage = F.when(F.col("__storage") == 1, F.lit(1024)).otherwise(F.col("__storage"))
    phone = F.struct(
        F.when(storage.isin(*STORAGES), storage).cast("int").alias("storage_gb"), F.when(~F.col("__color").isin("", "null"), T.first_tag(T.folded(F.col("__color")), T.COLORS)).alias("color"), F.when(F.col("__battery").between(1, 100), F.col("__battery")).cast("int").alias("battery_pct"),
    )
    return read.select(*replies.columns, analysis.alias("analysis"), F.when(F.col(category) == PHONE, phone).alias("fields")), bad


def backlog(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Active listings with a description and no analysis; the ``limit`` first by id, for one round of the model."""
    waiting = listings.filter(F.col("status").isin(*ACTIVE) & F.col("analysis").isNull() & F.col("description").isNotNull())
    return waiting if limit is None else waiting.orderBy("id").limit(limit)


def fill_missing(listings: DataFrame, replies: DataFrame) -> DataFrame:
    """The listings that good ``replies`` (id, analysis, fields) change, as they are then, with ``filled``: how many values were missing.

    What is there is never replaced. The variant is resolved again only where
    the storage came in. A listing whose analysis is there already is done, so
    that the same replies change nothing a second time.
    """
    met = listings.join(replies.select("id", F.col("analysis").alias("__analysis"), F.col("fields").alias("__fields")), "id").filter(F.col("analysis").isNull())
    lacks = {"storage_gb": F.col("storage_gb").isNull(), "color": F.coalesce("color", F.lit("")) == "", "battery_pct": F.col("battery_pct").isNull()}
    fills = {c: lack & F.col(f"__fields.{c}").isNotNull() for c, lack in lacks.items()}
    none = F.lit(None)
    resolved = variant_key(F.lit(PHONE), F.col("title"), F.col("__fields.storage_gb"), none.cast("string"), none.cast("int"), none.cast("int"))
    values = {c: F.when(fill, F.col(f"__fields.{c}")).otherwise(F.col(c)) for c, fill in fills.items()}
    out = met.withColumns({**values, "variant_key": F.when(fills["storage_gb"], resolved).otherwise(F.col("variant_key")), "filled": sum((f.cast("int") for f in fills.values()), F.lit(0)), "analysis": F.col("__analysis")})
    return out.select(*listings.columns, "filled")


def distribution(listings: DataFrame, key: str = "model") -> DataFrame:
    """Per model: active listings analysed, by reason, those that can be repaired, and those of would-be private sellers."""
    a = F.col("analysis")
    reason = lambda name: F.count_if(a["categoria_motivo"] == name).alias(name)
    active = listings.filter(F.col("status").isin(*ACTIVE))
    return active.groupBy(key).agg(F.count(a).alias("analysed"), *map(reason, REASONS[:3]), F.count_if(a["riparabile"]).alias("repairable"), F.count_if(F.col("seller_type") == "finto_privato").alias("fake_private"))
