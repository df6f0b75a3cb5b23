"""SQL pieces that the oracles share."""

from __future__ import annotations

LISTINGS = """listings AS (
  SELECT o_orderkey AS id, o_custkey AS seller_id, c_mktsegment AS model, c_mktsegment || '-' || c_nationkey AS variant_key,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'automobile' ELSE 'smartphone' END AS category, o_totalprice AS price,
         CASE o_orderstatus WHEN 'F' THEN 'venduto_rimosso' WHEN 'O' THEN 'nuovo' ELSE 'visto' END AS status,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'come-nuovo' WHEN '4' THEN 'difetti' WHEN '5' THEN 'rotto' ELSE 'buono' END AS tier,
         o_orderdate AS found_at, [64, 128, 256, 512][c_nationkey % 4 + 1] AS storage_gb, ['Nero', 'Bianco', 'Blu', 'Rosso', 'Verde'][c_nationkey % 5 + 1] AS color
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SALES = (
    LISTINGS
    + """, shipped AS (SELECT l_orderkey AS id, max(l_shipdate) AS shipped_at FROM lineitem GROUP BY 1),
sales AS (SELECT l.*, CASE WHEN status = 'venduto_rimosso' THEN shipped_at END AS sold_at FROM listings l LEFT JOIN shipped USING (id)),
facts AS (SELECT * FROM (SELECT *, (epoch_us(sold_at) - epoch_us(found_at)) / 86400000000::DOUBLE AS days FROM sales WHERE status = 'venduto_rimosso') WHERE days BETWEEN 0 AND 365)"""
)
HISTORY = "history AS (SELECT l_orderkey AS listing_id, l_extendedprice AS old_price, l_extendedprice * (1 - l_discount) AS new_price, l_shipdate AS changed_at FROM lineitem)"
RUNS = """counted AS (SELECT event_id AS id, event_type AS category, ts AS ran_at, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS targets, value FROM events),
parted AS (SELECT *, targets % 4 AS failed, floor(value)::INTEGER AS scraped FROM counted),
runs AS (SELECT *, greatest(0, targets - 10 * failed) AS ok, scraped % 7 AS new_count FROM parted),
judged AS (SELECT *, CASE WHEN targets = 0 THEN 'idle' WHEN ok = 0 OR scraped = 0 THEN 'down' WHEN failed > 0 THEN 'degraded' ELSE 'ok' END AS status FROM runs)"""
HEALTHY = "tier IN ('come-nuovo', 'buono')"
ACTIVE = "status NOT IN ('scaduto', 'venduto_rimosso')"


def quantile(a: str, i: int, n: int) -> str:
    at = f"greatest(1, least(len({a}) - 1, ({i} * (len({a}) + 1)) // {n}))"
    over = f"({i} * (len({a}) + 1) - {at} * {n})"
    return f"(CASE WHEN len({a}) >= 2 THEN ({a}[{at}] * ({n} - {over}) + {a}[{at} + 1] * {over}) / {n} END)"


def median(a: str) -> str:
    return f"(CASE WHEN len({a}) % 2 = 1 THEN {a}[(len({a}) + 1) // 2] ELSE ({a}[len({a}) // 2] + {a}[len({a}) // 2 + 1]) / 2 END)"


def mean(a: str) -> str:
    return f"(list_sum(list_transform({a}, lambda v: v::DECIMAL(18, 2)))::DOUBLE / len({a}))"


def fenced(source: str, keys: str, name: str, least: int) -> str:
    """CTEs from ``source`` (keys, price) to ``name`` (keys, p): sorted prices inside the fences."""
    return f"""{name}_all AS (SELECT {keys}, list_sort(list(price)) AS p FROM {source} WHERE price > 0 GROUP BY {keys}),
{name}_cut AS (SELECT *, {quantile("p", 1, 4)} AS q1, {quantile("p", 3, 4)} AS q3 FROM {name}_all),
{name} AS (SELECT * FROM (SELECT {keys}, CASE WHEN len(p) < 4 OR q3 - q1 <= 0 THEN p ELSE list_filter(p, lambda v: v >= q1 - 1.5::DOUBLE * (q3 - q1) AND v <= q3 + 1.5::DOUBLE * (q3 - q1)) END AS p FROM {name}_cut) WHERE len(p) >= {least})"""
