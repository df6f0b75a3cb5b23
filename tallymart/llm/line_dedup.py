"""Boilerplate lines by their frequency within a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.rows import free_name
from tallymart.staging import stage

#: A line is boilerplate of its host if more than this share of the host's pages hold it, and more than one: what one page alone holds is not repeated.
RATIO, MIN_PAGES = 0.1, 2


def _host(column: str) -> Column:
    """Null is a host of its own, apart from any named one."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(df: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, line_hashes)``: per host, the 64-bit hashes of its boilerplate lines.

    Every page counts a line once, and lines without a word count nowhere. A
    host's list is no longer than its mean number of lines a page over
    ``ratio``. Pages and lines are pre-aggregated before the shuffle, so a host
    with a third of all pages costs no more than others.
    """
    pages = df.select(_host(host_col).alias("host"), F.col(text_col).alias("text"))
    seen = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), lambda line: F.xxhash64(line)))
    pages_with = pages.select("host", F.explode(seen).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return pages_with.join(totals, "host").filter(F.col("pages") > F.col("total") * F.lit(float(ratio))).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("line_hashes"))


def drop_boilerplate(df: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``df`` with the boilerplate lines of each row's host gone from ``text_col``.

    Rows and other columns stay as they are. A null text stays null and a null
    host is a host of its own; a page whose lines all go keeps an empty text;
    repeated rows each count as a page; an empty table stays empty. With
    ``counts`` the columns ``n_lines`` (lines with a word) and ``n_dropped``
    replace all but nothing: they are added, and take the place of columns of
    the same name.

    A page first intersects its lines with its host's list, by hashing, and
    then looks each line up in the few that are left. The list of boilerplate
    is written first, so the planner knows its size
    and broadcasts it only below its threshold; otherwise rows meet it by host,
    where adaptive execution splits a hot host.
    """
    host, listed, n, dropped = (free_name(df, f"__tm_{c}") for c in ("host", "lines", "n", "kept"))
    found = stage(boilerplate(df, text_col, host_col, ratio, min_pages), "boilerplate").select(F.col("host").alias(host), F.col("line_hashes").alias(listed))
    joined = df.withColumn(host, _host(host_col)).join(found, host, "left")
    lines = _lines(F.col(text_col))
    hit = F.col(listed).isNotNull()
    joined = joined.withColumn(listed, F.when(hit, F.array_intersect(F.transform(lines, lambda line: F.xxhash64(line)), F.col(listed))))
    kept = F.filter(lines, lambda line: ~(_has_word(line) & F.array_contains(listed, F.xxhash64(line))))
    if counts:
        with_word = F.size(F.filter(lines, _has_word))
        joined = joined.withColumns({n: with_word, dropped: F.when(hit, F.size(lines) - F.size(kept)).otherwise(0)})
    cleaned = F.when(hit & F.col(text_col).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, cleaned)
    if counts:
        out = out.withColumns({"n_lines": F.col(n).cast("long"), "n_dropped": F.col(dropped).cast("long")})
    columns = [*df.columns, *[c for c in ("n_lines", "n_dropped") if counts and c not in df.columns]]
    return out.select(*[F.col(f"`{c}`") for c in columns])
