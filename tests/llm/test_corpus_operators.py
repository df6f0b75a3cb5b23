"""Operators over whole tables against brute force, with the cases that their docstrings define."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import hosts, jaccard, line_dedup, mixing, neighbors
from tallymart.llm.components import connected_components
from tallymart.session import ship_package

DOCS = "doc_id long, text string, source string, n long, class string, size string"


def docs_of(spark, texts, sources=None):
    ship_package(spark)
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    parent = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((find(parent, i), find(parent, j)))
            parent[high] = low
    return {i: (len(s), find(parent, i)) for i, s in enumerate(sets)}


def near_copies(seed, groups=12, size=8, words=120):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(random.choice(vocabulary) for _ in range(60))
    texts = []
    for g in range(groups):
        base = [random.choice(vocabulary) for _ in range(random.randint(6, words))]
        for _ in range(size):
            copy = list(base)
            for _ in range(random.choice((0, 0, 1, 1, 2, 3))):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + common if g % 3 == 0 else ""))
    return [*texts, *texts[:6], None, "", "one two", "ONE  two", "a b c d", " \n", common, common.upper()]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_all_pairs(spark, seed):
    texts = near_copies(seed)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_tiles_find_what_the_outermost_classes_miss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "TURNS", 0)
    texts = near_copies(3, groups=3, size=25, words=60)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_edge_tables(spark):
    assert jaccard.jaccard_components(docs_of(spark, ["x"]).limit(0)).count() == 0
    repeated = docs_of(spark, ["a b c d e f", "a b c d e f", "long " * 30_000])
    rows = jaccard.jaccard_components(repeated.unionAll(repeated)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 1, 2), (2, 1, 2)]


def test_bit_count_never_hides_an_overlap():
    random.seed(4)
    for _ in range(200):
        pool = np.unique(np.array([random.getrandbits(64) for _ in range(300)], np.uint64))
        a, b = (np.sort(np.random.default_rng(random.randrange(99)).choice(pool, random.randint(1, 250), replace=False)) for _ in range(2))
        x, y = jaccard.signature(a).view(np.uint64), jaccard.signature(b).view(np.uint64)
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200, 260)] + [(5, i) for i in range(6, 40)] + [(5, 5), (6, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{i: 5 for i in range(5, 40)}}
    assert connected_components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_line_dedup_equals_plain_counts(spark):
    random.seed(6)
    texts, sources = [], []
    for i in range(120):
        lines = [f"line {random.randrange(5000)}" for _ in range(random.randint(0, 6))]
        lines += ["footer"] * (i % 3 == 0) + ["rare"] * (i % 40 == 0) + ["", " "] * (i % 7 == 0) + ["footer"] * (i % 9 == 0)
        random.shuffle(lines)
        texts.append("\n".join(lines) if i % 11 else None)
        sources.append(["a", "b", None, "+a"][i % 4])
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs_of(spark, texts, sources).withColumn("n_lines", F.lit("clash")), counts=True).collect()}
    for s in set(sources):
        pages = [i for i in range(120) if sources[i] == s]
        for i in pages:
            lines = (texts[i] or "").split("\n")
            worded = [line for line in lines if line.strip(" \t\n\r\x0b\x0c")]
            holders = {line: sum(line in (texts[j] or "").split("\n") for j in pages) for line in set(worded)}
            gone = {line for line, n in holders.items() if n >= line_dedup.MIN_PAGES and n > len(pages) * line_dedup.RATIO}
            assert got[i].n_lines == len(worded) and got[i].n_dropped == sum(line in gone for line in lines)
            assert got[i].text == (None if texts[i] is None else "\n".join(line for line in lines if line not in gone))
    assert line_dedup.drop_boilerplate(docs_of(spark, ["x"]).limit(0)).count() == 0
    kept = line_dedup.drop_boilerplate(docs_of(spark, ["x\ny"]))
    assert kept.columns == ["doc_id", "text", "source", "n", "class", "size"] and kept.first().text == "x\ny"


def test_mix_meets_its_targets(spark):
    random.seed(8)
    sources = [random.choice(["a", "a", "a", "b", "c", None]) for _ in range(600)]
    texts = [None if i % 50 == 0 else "w " * random.randint(0, 40) for i in range(600)]
    rows = mixing.plan_mix(docs_of(spark, texts, sources)).collect()
    sizes = {i: len((texts[i] or "").split()) for i in range(600)}
    assert all(r["size"] == sizes[r.doc_id] and r.taken == r["size"] * r.copies <= 2 * r["size"] and len(r.positions) == r.copies for r in rows)
    total, weights = 1.5 * sum(sizes.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    size = {s: sum(sizes[i] for i in range(600) if sources[i] == s) for s in weights}
    level = lambda x: sum(min(2 * size[s], x * weights[s]) for s in weights) - total
    low, high = 0.0, total
    for _ in range(200):
        low, high = (low, (low + high) / 2) if level((low + high) / 2) > 0 else ((low + high) / 2, high)
    for s in weights:
        mine = [r for r in rows if sources[r.doc_id] == s]
        target = min(2 * size[s], low * weights[s])
        assert all(r.target == pytest.approx(target, rel=1e-6) and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(sizes.values())
        assert all(0 <= p <= 1 for r in mine for p in r.positions)
    again = {r.doc_id: r.positions for r in mixing.plan_mix(docs_of(spark, texts, sources).repartition(7)).collect()}
    assert again == {r.doc_id: r.positions for r in rows}
    mixed = mixing.mix(docs_of(spark, texts, sources))
    assert mixed.count() == sum(r.copies for r in rows) and mixed.columns == ["doc_id", "text", "source", "n", "class", "size"]
    assert mixing.plan_mix(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_curriculum_follows_its_schedule(spark):
    """A source with a rising rate is read later than one with a falling rate."""
    plan = mixing.plan_mix(docs_of(spark, ["w " * 10] * 900, ["a", "b", "c"] * 300), weights=(1, 1, 1)).select("doc_id", F.explode("positions").alias("at"))
    mean = {r["s"]: r["m"] for r in plan.groupBy((F.col("doc_id") % 3).alias("s")).agg(F.avg("at").alias("m")).collect()}
    assert mean[0] > mean[1] > mean[2]


def test_mix_of_repeated_rows_and_null_ids(spark):
    """Ids that repeat with the same and with other texts, null ids, and columns named like those of the plan."""
    random.seed(9)
    rows = [(None if i % 9 == 0 else i % 20, f"{'w ' * (i % 7)}x{i % 3}", ["a", "b", None][i % 3], "k", i) for i in range(120)] + [(3, None, "a", "k", 0)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, positions long").repartition(5)
    planned = {r.w: r.t for r in mixing.plan_mix(df).groupBy("doc_id", "size").agg(F.sum("copies").alias("t")).select(F.struct("doc_id", "size").alias("w"), "t").collect()}
    got = mixing.mix(df)
    mixed = {r.w: r.t for r in got.groupBy(F.struct("doc_id", mixing.word_count(F.col("text")).alias("size")).alias("w")).agg(F.count("*").alias("t")).collect()}
    assert got.columns == df.columns and mixed == {w: t for w, t in planned.items() if t}
    assert max(r.n for r in got.groupBy("doc_id", "text", "source", "positions").agg((F.count("*") / (1 + 3 * F.col("text").isNull().cast("int"))).alias("n")).collect()) <= 2
    assert mixing.mix(df.limit(0)).count() == 0


def vectors_of(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank int, class string")


def test_neighbors_small_tables_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[20][1]) for i in range(150, 210)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0] * 7), (380, [1.0] * 7 + [None]), (400, [float("inf")] * 8)]
    table = dict(rows[:210])
    got = {}
    for r in neighbors.nearest(vectors_of(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    x = np.array([table[i] for i in range(210)], np.float64)
    assert sorted(got) == list(range(0, 210, 20))
    found = 0
    for q, ranked in got.items():
        scores = (x * x[q]).sum(axis=1)
        wanted = [i for i in np.lexsort((np.arange(210), -scores)) if i != q][:20]
        assert sorted(ranked) == list(range(1, 21)) and all(ranked[k][1] == pytest.approx(scores[ranked[k][0]], abs=1e-12) for k in ranked)
        assert [ranked[k] for k in sorted(ranked)] == sorted(ranked.values(), key=lambda p: (-p[1], p[0]))
        found += len({p[0] for p in ranked.values()} & set(wanted))
    assert found >= 0.95 * 20 * len(got)


def test_neighbors_recall_among_many_vectors(spark):
    """Recall against brute force over vectors without structure, where lists are cut; no query far below it, and equal reruns."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    table = vectors_of(spark, [(i, v) for i, v in enumerate(x.tolist())])
    found = {}
    rows = neighbors.nearest(table).collect()
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.id)
    wide, recalls = x.astype(np.float64), []
    for q in range(0, 20_000, 20):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        recalls.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recalls) >= 0.93 and np.min(recalls) >= 0.5, (np.mean(recalls), np.min(recalls))
    assert sorted(map(tuple, neighbors.nearest(table.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_neighbors_with_few_vectors(spark):
    rows = neighbors.nearest(vectors_of(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [-3.0, 1.0])])).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.score) for r in rows] == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, -3.0)]
    assert neighbors.nearest(vectors_of(spark, [(0, [1.0, 0.0])])).count() == 0
    assert neighbors.nearest(vectors_of(spark, [(0, [1.0])]).limit(0)).count() == 0


def test_an_id_with_several_vectors_is_one_query_and_one_candidate(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(20, [3.0, 0.0, 0.0, 0.0]), (7, [2.0, 2.0, 0.0, 0.0]), (7, [0.0, 0.0, 5.0, 0.0]), (9, [0.0, 0.0, 5.0, 0.0]), (20, [0.0, 0.0, 4.0, 1.0]), (21, [1.0, 2.0])]
    vectors = {}
    for i, v in rows[:-1]:
        vectors.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    got = {}
    for r in neighbors.nearest(vectors_of(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(got) == [0, 20]
    for q, found in got.items():
        best = {i: max(float(a @ b) for a in vectors[q] for b in own) for i, own in vectors.items() if i != q}
        wanted = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        assert [(n, i) for n, i, _ in sorted(found)] == [(n, i) for n, (i, _) in enumerate(wanted, 1)]
        assert [s for *_, s in sorted(found)] == pytest.approx([s for _, s in wanted])


def test_neighbors_that_find_too_few_ask_all_pivots(spark, monkeypatch):
    for name, value in (("ASKED", 1), ("POSTED", 1), ("PIVOTS", 40), ("VECTORS_A_PIVOT", 2)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    assert {(r.query_id, r.n) for r in neighbors.nearest(vectors_of(spark, rows)).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {(0, 20), (20, 20), (40, 20)}


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1.0) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, trust double")


def test_urls_hosts_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://b.com/en/x#y": ("b.com", "/en/x", "com/en/", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://xcom/en/": ("xcom", "/en/", None, "allow"), "https://m.example.net/de/80": ("m.example.net", "/de/80", "example.net/de/8", "block"),
        "https://q.net/de/": ("q.net", "/de/", "net/de/", "allow"), "no scheme": ("", "", None, "allow"), "x://?a://b/c": ("", "", None, "allow"), "http://h.org": ("h.org", "", None, "allow"),
        "http://www.spam-farm.example.org/fr/1": ("www.spam-farm.example.org", "/fr/1", None, "block"), "http://h.org/a\n/b?c": ("h.org", "/a\n/b", None, "allow"),
    }
    rows = {r.id: r for r in hosts.judge_urls(pages_of(spark, [*((u, None) for u in cases), (None, None)])).collect()}
    for i, wanted in enumerate(cases.values()):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == wanted
    assert (rows[len(cases)].host, rows[len(cases)].path, rows[len(cases)].verdict) == ("", "", "allow")
    assert hosts.judge_urls(pages_of(spark, [("http://x/", "")]).limit(0)).count() == 0


def test_trust_spreads_forward_and_distrust_backward(spark):
    link = lambda *targets: "".join(f'<a href="https://{t}/x">t</a>' for t in targets)
    pages = [
        ("http://good.example.com/en/7", link("friend.org")), ("http://friend.org/1", link("neutral.org")), ("http://shill.org/1", link("spam-farm.io", "spam-farm.io")),
        ("http://spam-farm.io/1", link("victim.org")), ("http://farm2.org/", link("shill.org")), ("http://victim.org/", None), ("http://neutral.org/", "<a href='/local'>"),
    ]
    rows = {r.host: r for r in hosts.judge_urls(pages_of(spark, pages)).collect()}
    assert [h for h, r in rows.items() if r.verdict == "block"] == sorted(["shill.org", "spam-farm.io", "farm2.org"], key=list(rows).index)
    assert rows["friend.org"].trust > rows["neutral.org"].trust > 0 and rows["victim.org"].distrust == 0
    edges = [("good.example.com", "friend.org"), ("friend.org", "neutral.org"), ("shill.org", "spam-farm.io"), ("spam-farm.io", "victim.org"), ("farm2.org", "shill.org")]
    score = {"good.example.com": 1.0}
    for _ in range(hosts.ROUNDS):
        new = {"good.example.com": 0.15}
        for a, b in edges:
            new[b] = new.get(b, 0) + 0.85 * score.get(a, 0)
        score = new
    assert rows["neutral.org"].trust == pytest.approx(score["neutral.org"])


def test_block_rules_and_a_table_seed_distrust(spark):
    link = lambda *targets: "".join(f'<a href="//{t}/x">t</a>' for t in targets)
    pages = [
        ("http://bad.com/en/1", None), ("http://bad.com/fr/1", None), ("http://feeder.io/1", link("bad.com")), ("http://listed.io/1", None), ("http://lists.io/1", link("listed.io")),
        ("http://good.example.com/en/7", link("clean.io")), ("http://clean.io/1", None), ("http://other.io/1", None),
    ]
    verdicts = lambda **more: [r.verdict for r in hosts.judge_urls(pages_of(spark, pages), blocked_labels=(), **more).orderBy("id").collect()]
    listed = spark.createDataFrame([("listed.io", 1), ("listed.io", 2)], "host string, seed int")
    assert verdicts() == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert verdicts(blocked=listed) == ["block", "block", "block", "block", "block", "allow", "allow", "allow"]
    assert verdicts(seed_rules=False) == ["block", *["allow"] * 7]


def test_ranks_settle_on_a_long_chain_and_a_cycle(spark):
    hops, damping = 12, 0.5
    edges = [("far", f"h{i}", f"h{i + 1}", 1.0) for i in range(hops)] + [("round", "a", "b", 1.0), ("round", "b", "a", 3.0), ("round", "b", "c", 1.0)]
    got = {
        (r.kind, r.host): r.score
        for r in hosts.spread(spark.createDataFrame(edges, "kind string, src string, dst string, weight double"), spark.createDataFrame([("far", "h0", 5.0), ("round", "a", 2.0)], "kind string, host string, seed double"), damping).collect()
    }
    a = (1 - damping) / (1 - damping**2 * 0.75)
    wanted = {("far", f"h{i}"): (1 - damping) * damping**i for i in range(hops + 1)} | {("round", "a"): a, ("round", "b"): a * damping, ("round", "c"): a * damping**2 / 4}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], rel=1e-6) for k in wanted)


def test_columns_named_like_internal_ones(spark, tmp_path):
    """Whatever other columns are called, they come through, also over files."""
    names = ["__tm_host", "__tm_lines", "__tm_n", "__tm_kept", "__tm_row", "__tm_asked", "__tm_position", "__tm_file", "__tm_at", "__tm_start", "rows"]
    docs = docs_of(spark, [f"head\nline {i}\nfoot" for i in range(40)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    docs.write.parquet(f"{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        kept = line_dedup.drop_boilerplate(table, counts=True)
        assert kept.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert {(r["text"], r["n_dropped"], r["__tm_lines"]) for r in kept.collect()} == {(f"line {i}", 2, f"__tm_lines{i}") for i in range(40)}
        mixed = mixing.mix(table)
        assert mixed.columns == docs.columns and mixed.count() == 60
        assert all(r[n] == f"{n}{r['doc_id']}" for r in mixed.collect() for n in names)
