"""URLs judged by rules, and by trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.staging import stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a score that travels along links, and the least lead of distrust over trust that blocks a host.
DAMPING, LEAD = 0.85, 0.0
#: Rounds go on until scores change by no more than this in sum.
TOLERANCE = 1e-9
#: Rounds that the SQL twin spells out; on tables without links they are the settled ones.
ROUNDS = 8
#: Absolute and scheme-relative targets in a page.
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """What a host, its subdomains, and paths that start so, get."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the query.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))
#: Names that make a host a blocked seed, as one of the labels of its name.
BLOCKED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``(name, verdict)``, else null."""
    fitted = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fitted = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(fitted)
    return fitted


def host_links(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, weight)``: pages of a host that link to another, for every pair of hosts. Each page counts a target once."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    pages = df.select(host_of(F.col(url_col)).alias("src"), F.explode(targets).alias("dst"))
    return pages.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(kind, host, score)``: personalised PageRank of ``seeds`` (kind, host, seed) over ``edges`` (kind, src, dst, weight).

    Seeds of a kind add up to 1, as its scores do, less what hosts without
    links would pass on. Kinds have edges of their own, so trust runs along
    the links and distrust against them in the same rounds. A round sums what
    arrives at each host, partial sums first, and is written to the shared
    folder. Rounds end when the changes of one add up to no more than
    ``tolerance`` and it reached no new host, so there are at least as many as
    the farthest reached host is links away; one row a round is collected.
    """
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = stage(seeds.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")), "seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = stage(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "shares")
    if not shares.head(1):
        return start.select("kind", "host", F.col("seed").alias("score"))
    now = start.select("kind", "host", F.col("seed").alias("score"))
    staged = None
    while True:
        sent = now.join(shares, (now["kind"] == shares["kind"]) & (now["host"] == shares["src"])).select(shares["kind"], F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        kept = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
        before = now.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        arrived = sent.unionByName(kept).withColumn("before", F.lit(None).cast("double"))
        new = stage(arrived.unionByName(before).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "ranks")
        moved = new.agg(F.sum(F.abs(F.col("score") - F.coalesce("before", F.lit(0.0)))).alias("by"), F.count_if(F.col("before").isNull()).alias("reached")).first()
        if staged is not None:
            unstage(staged)
        staged, now = new, new.select("kind", "host", "score")
        if not moved["reached"] and (moved["by"] or 0.0) <= tolerance:
            break
    return now


def host_scores(df: DataFrame, trusted: DataFrame, blocked: DataFrame, url_col: str = "url", html_col: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust)`` of all hosts that a seed reaches; seeds are ``(host, seed)``."""
    links = stage(host_links(df, url_col, html_col), "links")
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    seeds = trusted.select(F.lit("trust").alias("kind"), "host", "seed").unionByName(blocked.select(F.lit("distrust").alias("kind"), "host", "seed"))
    scores = spread(forward.unionByName(backward), seeds, damping, tolerance)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(df: DataFrame, rules: Sequence[Rule] = RULES, blocked_labels: Sequence[str] = BLOCKED_LABELS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lead: float = LEAD, blocked: DataFrame | None = None, seed_rules: bool = True) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)`` for each row.

    The longest rule that fits decides. Otherwise the host does: hosts with a
    page that an allow rule fits are trusted seeds, weighted by such pages;
    hosts with a page that a block rule fits are blocked seeds, weighted by
    such pages, unless ``seed_rules`` is false; hosts with a blocked name are
    blocked seeds, weighted by their pages, and never trusted ones; those of
    ``blocked`` (host, seed) are added. A host is blocked where its distrust exceeds its trust
    by more than ``lead``, and allowed else, unknown and empty hosts among
    them. A null url has an empty host and path; a null html no links;
    repeated rows give repeated rows and count as pages; an empty table gives
    none. Pages meet the scores by host, of which there is one row each.
    """
    parsed = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parsed.withColumn("fitted", rule_for(F.col("host"), F.col("path"), rules))
    bad = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, blocked_labels))) if blocked_labels else F.lit(False)
    per_host = stage(ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("fitted.verdict") == "allow").alias("allowed"), F.count_if(F.col("fitted.verdict") == "block").alias("ruled_out"), F.count("*").alias("pages")).withColumn("bad", bad), "hosts")
    trusted = per_host.filter(~F.col("bad") & (F.col("allowed") > 0)).select("host", F.col("allowed").cast("double").alias("seed"))
    weight = F.when(F.col("bad"), F.col("pages")).otherwise(F.col("ruled_out") if seed_rules else F.lit(0)).cast("double")
    distrusted = per_host.select("host", weight.alias("seed")).filter("seed > 0")
    if blocked is not None:
        distrusted = distrusted.unionByName(blocked.select("host", F.col("seed").cast("double").alias("seed"))).groupBy("host").agg(F.sum("seed").alias("seed"))
    scores = stage(host_scores(df, trusted, distrusted, url_col, html_col), "scores")
    judged = ruled.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    verdict = F.coalesce("fitted.verdict", F.when(F.col("distrust") - F.col("trust") > lead, "block").otherwise("allow"))
    return judged.select("id", "host", "path", F.col("fitted.name").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
