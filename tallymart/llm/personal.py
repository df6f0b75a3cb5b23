"""Personal data in texts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban")
#: Patterns of the kinds. They find what the plain patterns find from left to
#: right; \G and the look-behinds keep a search from starting again inside a
#: run that has just failed, and possessive loops from going back into it, so
#: the search stays linear in the text and the stack flat; see _folded for what follows it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2})(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
}
#: Countries by the length of their IBANs. Of other countries the longest prefix that passes is taken.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: How sure a valid span is by itself, and what a word nearby adds.
SURE, NEARBY, REACH = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}, 0.2, 40
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel|call|mobile|telefon|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,score:double>>"
#: Matches that are folded into one list before it joins the lists before it.
BLOCK = 512


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def _luhn(found: Column) -> Column:
    """Whether the digits pass Luhn: from the right every second one doubled, less 9 if above."""
    each = F.split(F.reverse(_digits(found)), "")
    valued = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(valued, F.lit(0), lambda total, d: total + d) % 10 == 0


def _mod_97(found: Column) -> Column:
    """Whether country and check digits, moved to the end, make the number 1 modulo 97; a letter stands for 10 to 35."""
    plain = F.regexp_replace(found, " ", "")
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(turned, F.lit(0), lambda acc, c: F.when(F.ascii(c) < 58, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _low_parts(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) < 3) | ((F.length(F.ltrim(part, F.lit("0"))) == 3) & (F.ltrim(part, F.lit("0")) <= "255")))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda found: F.lit(True),
    "ip": _low_parts,
    "card": lambda found: F.length(_digits(found)).between(12, 19) & _luhn(found),
    "phone": lambda found: F.length(_digits(found)).between(9, 15),
}


def _folded(matches: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The spans that ``step`` gives from left to right: of a state and a match the next state and a list of spans.

    A list that grows by a match at a time would be copied as often, so
    matches are folded in blocks, each into a list of its own, and the lists
    are joined once at the end: time is linear in the matches for up to many
    millions of them.
    """
    none = F.array().cast(_SPANS)

    def in_blocks(every: Column) -> Column:
        last = F.greatest(F.ceil(F.size(every) / BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(every, b * BLOCK + 1, BLOCK))

    blocks = F.flatten(F.transform(F.array(matches), in_blocks))  # a variable, so that matches are made once

    def of_block(acc: Column, block: Column) -> Column:
        def one(inner: Column, match: Column) -> Column:
            state, spans = step(inner["state"], match)
            return F.struct(state.alias("state"), F.concat(inner["spans"], spans).alias("spans"))

        return F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("spans")), one, lambda end: F.struct(end["state"].alias("state"), F.concat(acc["lists"], F.array(end["spans"])).alias("lists")))

    return F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<{_SPANS}>").alias("lists")), of_block, lambda acc: F.flatten(acc["lists"]))


def _span(kind: str, begin: Column, size: Column, good: Column, near: Column) -> Column:
    score = F.lit(SURE[kind]) + F.when(near, F.lit(NEARBY)).otherwise(F.lit(0.0))
    span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (begin + size).alias("end"), score.alias("score"))).cast(_SPANS)
    return F.when(good, span).otherwise(F.array().cast(_SPANS))


def _placed(kind: str) -> Column:
    """Valid matches of a kind as ``(start, rank, end, score)``, from its matches and the gaps around them.

    Gaps and matches alternate, so their lengths add up to code-point offsets.
    Words of the context count in the gaps before and after.
    """
    def match(found: Column, i: Column) -> Column:
        before, after = F.get(f"gaps_{kind}", i), F.get(f"gaps_{kind}", i + 1)
        near = F.substring(before, -REACH, REACH).rlike(CONTEXT[kind]) | F.substring(after, 1, REACH).rlike(CONTEXT[kind])
        return F.struct(F.char_length(before).cast("bigint").alias("skip"), F.char_length(found).cast("bigint").alias("size"), VALID[kind](found).alias("good"), near.alias("near"))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + m["skip"]
        return begin + m["size"], _span(kind, begin, m["size"], m["good"], m["near"])

    return _folded(F.transform(f"found_{kind}", match), F.lit(0).cast("bigint"), step)


def _iban_length(run: Column) -> Column:
    """Characters of the IBAN that ``run`` begins with, null without one.

    It ends where no letter or digit follows, has its country's length
    without spaces (15 to 34 for countries not in the table) and passes
    modulo 97.
    """
    length = F.lit(None).cast("int")
    for size, countries in IBAN_LENGTHS.items():
        length = F.when(F.substring(run, 1, 2).isin(*countries.split()), F.lit(size)).otherwise(length)
    sizes = F.sequence(F.coalesce(length, F.lit(15)), F.coalesce(length, F.lit(34)))
    prefixes = F.transform(sizes, lambda n: F.call_function("regexp_extract", run, F.concat(F.lit(r"^[A-Z0-9](?:\x20?[A-Z0-9]){"), (n - 1).cast("string"), F.lit(r"}(?![A-Za-z0-9])")), F.lit(0)))
    good = F.filter(prefixes, lambda p: F.when(p == "", F.lit(False)).otherwise(_mod_97(p)))
    return F.char_length(F.try_element_at(good, F.lit(-1)))


def _placed_ibans() -> Column:
    """Like ``_placed``: a match is country and check digits alone, so that no run hides the IBAN after it, and each begins a run of up to 34 characters.

    From left to right, none within another. The words before reach back over
    heads of runs that were none, but not into the IBAN before.
    """
    def match(head: Column, i: Column) -> Column:
        size = _iban_length(F.concat(head, F.get("runs_iban", i))).cast("bigint")
        return F.struct(F.get("gaps_iban", i).alias("gap"), head.alias("head"), size.alias("size"), F.get("gaps_iban", i + 1).alias("next"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("free"), F.lit("").alias("before"))

    def step(acc: Column, m: Column) -> tuple[Column, Column]:
        begin, heads = acc["at"] + F.char_length(m["gap"]), F.char_length(m["head"])
        good = m["size"].isNotNull() & (begin >= acc["free"])
        before = F.concat(acc["before"], F.substring(m["gap"], -REACH, REACH))
        near = F.right(before, F.least(F.lit(REACH), begin - acc["free"]).cast("int")).rlike(CONTEXT["iban"])
        after = F.substring(m["next"], (m["size"] - heads + 1).cast("int"), F.lit(REACH)).rlike(CONTEXT["iban"])
        state = F.struct((begin + heads).alias("at"), F.when(good, begin + m["size"]).otherwise(acc["free"]).alias("free"), F.substring(F.concat(before, m["head"]), -REACH, REACH).alias("before"))
        return state, _span("iban", begin, m["size"], good, near | F.coalesce(after, F.lit(False)))

    return _folded(F.transform("found_iban", match), start, step)


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``: ``(kind, start, end, score)`` by start and kind, code points, end exclusive.

    Patterns propose, checks (Luhn, modulo 97, ranges, lengths) confirm, and
    words before or after a span raise its score, which drops nothing. A null or empty
    text has no spans; repeated rows give repeated rows; an empty table gives
    none. Rows stay where they are: nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({f"found_{k}": F.when(F.col("text").rlike(HINTS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(int(k == "iban")))).otherwise(none) for k in KINDS})
    out = out.withColumn("runs_iban", F.when(F.size("found_iban") > 0, F.regexp_extract_all("text", F.lit(PATTERNS["iban"]), F.lit(2))).otherwise(none))
    out = out.withColumns({f"gaps_{k}": F.when(F.size(f"found_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    out = out.select("id", *[F.when(F.size(f"found_{k}") > 0, _placed_ibans() if k == "iban" else _placed(k)).otherwise(F.array().cast(_SPANS)).alias(f"spans_{k}") for k in KINDS])
    merged = F.sort_array(F.concat(*[F.col(f"spans_{k}") for k in KINDS]))
    names = F.array(*map(F.lit, KINDS))
    return out.select("id", F.transform(merged, lambda s: F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))
