"""The numbered operators as queries over whole tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import hosts, jaccard, licenses, line_dedup, mixing, neighbors, personal, pieces, quality, runs, search, secrets, suffixes
from tallymart.session import ship_package
from tallymart.sources import table

#: The vocabulary that op2 and the pipeline encode with; the operators take any path.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines with a word, those dropped, and a digest of what is left."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLES["op1_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs WHERE text IS NOT NULL
), worded AS (
  SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t-\\r]')
), totals AS (
  SELECT source, count(*) AS total FROM docs GROUP BY source
), boiler AS (
  SELECT worded.source, line FROM worded JOIN totals ON worded.source IS NOT DISTINCT FROM totals.source
  GROUP BY worded.source, line HAVING count(DISTINCT r) >= {line_dedup.MIN_PAGES} AND count(DISTINCT r) > any_value(total) * {line_dedup.RATIO}
), marked AS (
  SELECT l.r, l.line, l.i, regexp_matches(l.line, '[^ \\t-\\r]') AS worded, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
), cleaned AS (
  SELECT r, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY r
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(c.text, '')) AS text_sha256
FROM docs d LEFT JOIN cleaned c USING (r)
"""


@_query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, the digest of what they decode to, and that of the spans of its pieces."""
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), PIECE_MODEL).withColumnRenamed("id", "doc_id")


@_query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of shingles and the least doc_id it reaches by links."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


ORACLES["op3_ngram_jaccard_join"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM worded
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.v) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.u GROUP BY s.doc_id, s.s
"""


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: places of the base phrases, and the labels of all notices found."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base secrets by kind, their digest, and all spans found."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))


def _secret_sql() -> str:
    """The base spans from plain patterns, offsets as running sums of gaps and matches."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = f"(?:{'|'.join(map(either, ('password', 'passwd', 'secret', 'token')))}|{either('api')}_?{either('key')})[\"'']? *[:=] *[\"'']?"
    plain = {"assign": f"{assign}[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    good = {"assign": f"length(regexp_replace(m, '^{assign}', '')) >= {secrets.ASSIGN_LEAST}", "access": f"length(m) >= {secrets.ACCESS_LEAST}", "hex": "length(m) >= 16"}
    parts = [f"""
{kind}_found AS (SELECT doc_id, regexp_extract_all(t, '{plain[kind]}') AS ms, string_split_regex(t, '{plain[kind]}') AS gs FROM texts),
{kind}_each AS (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM {kind}_found WHERE len(ms) > 0),
{kind}_placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_each),
{kind}_good AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM {kind}_placed WHERE {good[kind]})""" for rank, kind in enumerate(plain)]
    union = " UNION ALL ".join(f"SELECT * FROM {kind}_good" for kind in plain)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in plain)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
joined AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM ({union}) GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in plain)}, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans FROM texts t LEFT JOIN joined USING (doc_id)
"""


#: The driver's tables hold no token with a checksum; the SQL has the base kinds, and the tests have the others.
ORACLES["op5_secret_scan"] = _secret_sql()


@_query
def op6_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return neighbors.nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind, their digest, all spans found, and the highest score."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = personal.KINDS[:4]
    out = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*base)))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score")
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), best)


def _personal_sql() -> str:
    """The same spans from plain patterns: gaps and matches alternate, so running sums of their lengths are offsets."""
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(?:\\.[0-9]+){3}", "card": "[0-9](?:[ -]?[0-9])+", "phone": "\\+[0-9][ ().0-9-]+[0-9]",
        "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\\b",
    }
    luhn = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INTEGER ELSE substr(d, length(d) - i, 1)::INTEGER * 2 - CASE WHEN substr(d, length(d) - i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    good = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND CASE WHEN length(ltrim(p, '0')) = 3 THEN ltrim(p, '0') <= '255' ELSE true END))",
        "card": f"length(d) BETWEEN 12 AND 19 AND {luhn}", "phone": "length(d) BETWEEN 9 AND 15", "iban": "false",
    }
    parts = []
    for rank, kind in enumerate(personal.KINDS[:4]):
        parts.append(f"""
{kind}_found AS (SELECT doc_id, regexp_extract_all(t, '{plain[kind]}') AS ms, string_split_regex(t, '{plain[kind]}') AS gs FROM texts),
{kind}_each AS (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(gs[2:len(ms) + 1]) AS h, unnest(range(len(ms))) AS i FROM {kind}_found WHERE len(ms) > 0),
{kind}_placed AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_each),
{kind}_good AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop, {personal.SURE[kind]}::DOUBLE + CASE WHEN regexp_matches(right(g, {personal.REACH}), '{personal.CONTEXT[kind]}') OR regexp_matches(left(h, {personal.REACH}), '{personal.CONTEXT[kind]}') THEN {personal.NEARBY}::DOUBLE ELSE 0 END AS score FROM {kind}_placed WHERE {good[kind]})""")
    union = " UNION ALL ".join(f"SELECT * FROM {kind}_good" for kind in personal.KINDS[:4])
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in personal.KINDS[:4])
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
spans AS (SELECT * FROM ({union})),
joined AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s, max(score) AS score FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in personal.KINDS[:4])}, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(score, 0.0::DOUBLE) AS score FROM texts t LEFT JOIN joined USING (doc_id)
"""


#: The driver's tables hold no valid IBAN; the SQL has the base kinds, and the tests have the others.
ORACLES["op7_personal_data"] = _personal_sql()


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its measures, whether a base rule fails, and whether it is kept."""
    judged = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host and path, the rule that fits, and the rule's or else the host's verdict."""
    judged = hosts.judge_urls(table(spark, sf_dir, "pages"), seed_rules=False)  # as its SQL, which seeds by name alone
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _url_sql() -> str:
    """Rules, links and rounds spelled out, one query block a round."""
    ordered = sorted(hosts.RULES, key=lambda r: -len(r.name))
    block = lambda pick: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{pick(r)}'" for r in ordered) + " END"
    bad = ", ".join(f"'{label}'" for label in hosts.BLOCKED_LABELS)
    rounds = "".join(f""",
round_{i + 1} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT s.kind, s.dst AS host, r.score * s.share * {hosts.DAMPING}::DOUBLE AS score FROM round_{i} r JOIN shares s ON r.kind = s.kind AND r.host = s.src
  UNION ALL SELECT kind, host, score * {1 - hosts.DAMPING}::DOUBLE FROM round_0) GROUP BY kind, host)""" for i in range(hosts.ROUNDS))
    return f"""
WITH split AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (SELECT *, {block(lambda r: r.name)} AS rule, {block(lambda r: r.verdict)} AS given FROM split),
named AS (SELECT host, count(*) FILTER (WHERE given = 'allow') AS allowed, count(*) AS pages, list_has_any(string_split(host, '.'), [{bad}]) AS bad FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, allowed::DOUBLE AS seed FROM named WHERE NOT bad AND allowed > 0 UNION ALL SELECT 'distrust', host, pages::DOUBLE FROM named WHERE bad),
targets AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)(?:href|src|action)\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s<>]+)', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM split),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM targets WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (SELECT 'trust' AS kind, src, dst, weight FROM links UNION ALL SELECT 'distrust', dst, src, weight FROM links),
shares AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM edges),
round_0 AS (SELECT kind, host, seed / sum(seed) OVER (PARTITION BY kind) AS score FROM seeds){rounds},
last_round AS (SELECT * FROM round_{hosts.ROUNDS}),
scores AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM last_round GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {hosts.LEAD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""


ORACLES["op9_url_filter"] = _url_sql()


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what the mix takes of it and when it is read first and again, range-sorted by the first position."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    read = [F.try_element_at("positions", F.lit(nth)).alias(name) for nth, name in ((1, "first_position"), (2, "second_position"))]
    return plan.select("doc_id", "size", "source_size", "target", "taken", *read).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLES["op10_mixing"] = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source
), dealt AS (
  SELECT *, [5.0, 2.0, 1.0][(nth - 1) % 3 + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][(nth - 1) % 3 + 1]::DOUBLE AS tilt,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM sources
), filled AS (
  SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS is_full
  FROM dealt WINDOW w AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT source, source_size, tilt, CASE WHEN is_full THEN cap ELSE weight * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM filled
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.tilt,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY turn, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + s.size / 2 AS middle
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), taken AS (
  SELECT *, (CASE WHEN middle <= target THEN 1 ELSE 0 END + CASE WHEN middle + source_size <= target THEN 1 ELSE 0 END) AS copies,
         CASE WHEN target > 0 THEN middle / target ELSE 0 END AS demand, CASE WHEN target > 0 THEN (middle + source_size * 1.0::DOUBLE) / target ELSE 0 END AS again FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN tilt = 0 THEN demand ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * demand) - (1 - tilt)) / (2 * tilt) END AS first_position,
       CASE WHEN copies < 2 THEN NULL WHEN tilt = 0 THEN again ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * again) - (1 - tilt)) / (2 * tilt) END AS second_position
FROM taken
"""


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of each benchmark item."""
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_UPPER, _LOWER, _TERM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')"


ORACLES["op11_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("text")} AS w FROM documents),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_terms_sql("text")}) AS w FROM benchmark),
asked AS (SELECT i, item_id, unnest(w) AS term FROM items),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, totals GROUP BY term),
lengths AS (SELECT r, doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM sized, totals),
scored AS (
  SELECT i, item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY i, item_id, r, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {search.TOP}
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts that op12 is held against: a tenth of the documents, by their id's checksum, get periodic ends."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", mark.alias("mark")).withColumn("words", F.when(F.col("mark") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    some = some.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("mark") / 10))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.element_at("words", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int") + 1)
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of runs, the strongest, and digests of all runs and of the text without their repeats."""
    found = runs.find_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside a benchmark window, and the items (by id) whose windows it holds."""
    found = suffixes.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform(F.array_distinct(F.transform("matches", lambda m: m["item"])), lambda i: i.cast("string")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op13_decontamination"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("text")} AS w FROM documents),
items AS (SELECT item_id, {_terms_sql("text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {suffixes.WINDOW}) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM sized)),
places AS (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT r, p.i, p.k, item_id FROM (SELECT r, i, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM places) p JOIN windows USING (k, s)),
hits AS (SELECT r, count(DISTINCT hit)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS hit FROM found) GROUP BY r),
named AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
