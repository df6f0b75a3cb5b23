"""Texts of alerts, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.text import euros


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def deal_alert(title: Column, price: Column, fair: Column, margin_pct: Column, score: Column, bid: Column, url: Column) -> Column:
    """Lines that are known; the others are left out."""
    lines = [
        F.concat(F.lit("<b>"), escaped(title), F.lit("</b>")), F.concat(F.lit("Prezzo: "), euros(price)), F.concat(F.lit("Valore equo: "), euros(fair)),
        F.concat(F.lit("Margine: "), F.format_number(margin_pct, 1), F.lit("%")), F.concat(F.lit("Score: "), score.cast("string"), F.lit("/100")), F.concat(F.lit("Offerta massima: "), euros(bid)), url,
    ]
    return F.concat_ws("\n", *lines)


def drop_alert(title: Column, old: Column, new: Column, url: Column) -> Column:
    share = F.format_number((old - new) / old * 100, 0)
    return F.concat_ws("\n", F.concat(F.lit("<b>"), escaped(title), F.lit("</b>")), F.concat(euros(old), F.lit(" → "), euros(new), F.lit(" (-"), share, F.lit("%)")), url)


# The texts of the two transitions, and the chats that an alert about ourselves goes to, the first that there is.
WENT_DOWN = "🔴 <b>Scraper DOWN</b> (%s)\n%d/%d target falliti, %d annunci raccolti.\nProbabile blocco Akamai o proxy KO — controlla."
RECOVERED = "🟢 <b>Scraper ripristinato</b> (%s) — %d annunci nell'ultimo giro."
OPS_CHATS = ("ops", "tech", "auto")


def ops_alerts(transitions: DataFrame, chats: Mapping[str, str | None]) -> DataFrame:
    """``(id, category, transition, chat, text)``: one alert for each run (id, category, targets, failed, scraped, transition) that changed its category's health.

    ``chats`` are the known chats by name; without any there is nobody to tell
    and ``chat`` is null.
    """
    category = F.coalesce("category", F.lit("all"))
    down = F.printf(F.lit(WENT_DOWN), category, F.coalesce("failed", F.lit(0)), F.coalesce("targets", F.lit(0)), F.coalesce("scraped", F.lit(0)))
    up = F.printf(F.lit(RECOVERED), category, F.coalesce("scraped", F.lit(0)))
    chat = next((chats[c] for c in OPS_CHATS if chats.get(c)), None)
    told = transitions.filter(F.col("transition").isin("went_down", "recovered"))
    return told.select("id", "category", "transition", F.lit(chat).cast("string").alias("chat"), F.when(F.col("transition") == "went_down", down).otherwise(up).alias("text"))
