"""Licence notices in texts by a positional index of rare words, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A notice: its words, and the key phrase at ``key_at`` without which it does not count."""

    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool = False


def _template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, wanted = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, at, wanted, base)


#: The base phrases, then notices of the method's own.
TEMPLATES = (
    _template("mit", "under the mit license", "under the mit license", True),
    _template("apache-2", "apache license version 2", "apache license version 2", True),
    _template("cc-by-nc", "cc by nc", "cc by nc", True),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    _template("mit", "license mit copyright", "license mit"),
    _template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    _template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    _template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    _template("agpl-3", "licensed under the gnu affero general public license", "gnu affero general public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    _template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Share of a template's words that must stand at their relative positions, weighted by their rarity.
COVERAGE = 0.6


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def rarity(df: DataFrame, text_col: str, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), _words(F.coalesce(F.col(text_col), F.lit(""))))
    counted = stage(df.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "rarity")
    n = {r["word"]: r["n"] for r in counted.collect()}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1 for w in vocabulary}


def _same(words: Column, at: Column, phrase: Column) -> Column:
    return (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``(id, n_words, places, labels, score)`` for each row.

    ``places`` are the ``(at, label)`` of base phrases, word numbers from 0;
    ``labels`` all labels, sorted; ``score`` the best weighted coverage, 1 for
    a base phrase, 0 for none. Words are compared with A-Z in lower case.

    The rarest word of each template in this corpus posts the template with
    its position. A text is looked through only if it holds such a word; each
    occurrence aligns the templates it is posted for, the other words vote by
    their relative positions, and the key phrase must stand where the
    alignment puts it. Every place of a phrase holds the phrase's rarest word,
    so no place is missed. Null and empty texts have no words; repeated rows
    give repeated rows; an empty table gives none; time is linear in a text.
    """
    weight = rarity(df, text_col, templates)
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")

    def anchor(t: Template) -> int:
        """Place of the rarest word of the key phrase."""
        return t.key_at + max(range(len(t.key)), key=lambda i: (weight[t.key[i]], -i))

    anchors = sorted({t.words[anchor(t)] for t in templates})
    hint = r"(?i)(?<![0-9A-Za-z])(?:" + "|".join(anchors) + r")(?![0-9A-Za-z])"
    literal = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*[F.lit(weight[w]) for w in t.words]).alias("weights"),
            F.lit(sum(weight[w] for w in t.words)).alias("total"), F.lit(t.words[anchor(t)]).alias("anchor"), F.lit(anchor(t)).alias("anchor_at"),
            F.array(*map(F.lit, t.key)).alias("key"), F.lit(t.key_at).alias("key_at"), F.lit(t.base).alias("base"),
        )
        for t in templates
    ])
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    worded = texts.select("id", n_words.alias("n_words"), F.when(F.col("text").rlike(hint), _words(F.col("text"))).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(*anchors))
    found = worded.withColumn("hits", F.when(F.col("words").isNotNull(), hits))

    def aligned(t: Column) -> Column:
        """Alignments of a template that its key phrase confirms, with their coverage."""
        starts = F.transform(F.filter("hits", lambda h: h["word"] == t["anchor"]), lambda h: h["at"] - t["anchor_at"])
        confirmed = F.filter(starts, lambda at: _same(F.col("words"), at + t["key_at"], t["key"]))

        def covered(at: Column) -> Column:
            votes = F.transform(t["words"], lambda w, j: F.when(F.get("words", F.when(at + j >= 0, at + j)) == w, F.element_at(t["weights"], j + 1)).otherwise(0.0))
            return F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / t["total"]

        return F.transform(confirmed, lambda at: F.struct(at.cast("long").alias("at"), t["label"].alias("label"), t["base"].alias("base"), covered(at).alias("score")))

    kept = F.filter(F.flatten(F.transform(literal, aligned)), lambda m: m["base"] | (m["score"] >= coverage))
    none = F.array().cast("array<struct<at:bigint,label:string,base:boolean,score:double>>")
    out = found.select("id", "n_words", F.when(F.size("hits") > 0, kept).otherwise(none).alias("matches"))
    base = F.sort_array(F.transform(F.filter("matches", lambda m: m["base"]), lambda m: F.struct(m["at"].alias("at"), m["label"].alias("label"))))
    best = F.aggregate("matches", F.lit(0.0), lambda a, m: F.greatest(a, F.least(F.when(m["base"], F.lit(1.0)).otherwise(m["score"]), F.lit(1.0))))
    return out.select("id", "n_words", base.alias("places"), F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["label"]))).alias("labels"), best.alias("score"))
