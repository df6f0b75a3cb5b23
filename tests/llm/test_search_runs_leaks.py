"""Ranked search, run detection and decontamination against brute force, with the cases their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import queries, runs, search, suffixes
from tallymart.session import ship_package

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, id string, row int, words string, matches int, score double"
ITEMS = "item_id long, text string, item string, id int"


def docs_of(spark, texts, ids=None):
    ship_package(spark)
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 0.5) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def items_of(spark, texts):
    return spark.createDataFrame([(100 + i, t, "x", 1) for i, t in enumerate(texts)], ITEMS)


def terms_in(text):
    return TERM.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=60, most=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Größe", "naïve", "x²"]
    return [" ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.randint(1, most))) for _ in range(n)]


# Ranked search


def brute_search(docs, items, top):
    worded = [(i, Counter(terms_in(t))) for i, t in docs]
    worded = [(i, c) for i, c in worded if c]
    n_docs, n_terms = len(worded), sum(sum(c.values()) for _, c in worded)
    df = Counter(t for _, c in worded for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in worded:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_in(text)) if c[t])
            if score > 0:
                scores.append((-score, (i is None, i if i is not None else 0), i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("window,block", [(4096, 1 << 18), (4, 1 << 18), (7, 12)])
def test_search_is_that_of_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "WINDOW_TERMS", 100 * window)
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    texts = prose(1, 60) + ["", None, "?!", "w1 w1 w1", "W1 w1 w1", "only here " * 3000]
    ids = list(range(60)) + [60, 61, 62, 63, 63, None]
    items = prose(2, 8, most=20) + ["", None, "w1 w1", "nowhere", "here", "w1"]
    found = search.search(docs_of(spark, texts, ids), items_of(spark, items), top=9).collect()
    assert sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in found), key=str) == brute_search(list(zip(ids, texts, strict=True)), [(100 + i, t) for i, t in enumerate(items)], 9)


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark, ["a b"]), items_of(spark, ["a"])
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [r["rank"] for r in search.search(docs, items).collect()] == [1]


def test_names_of_any_type(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y")], "name string, body string")
    items = spark.createDataFrame([("q", "x")], "key string, body string")
    ship_package(spark)
    assert [(r["item"], r["rank"], r["id"]) for r in search.search(docs, items, 5, "name", "body", "key", "body").orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]



def test_windows_are_stored_and_read_one_at_a_time(spark, monkeypatch):
    """A reader holds a group of rows at once, so a task with many windows must not write them as one."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(search, "WINDOW", 4)
    index = search.stored_index(docs_of(spark, prose(3, 60)).coalesce(1))
    groups = [f.metadata.row_group(g).num_rows for f in (pq.ParquetFile(name.removeprefix("file://")) for name in index.inputFiles()) for g in range(f.num_row_groups)]
    assert len(groups) == 15 and max(groups) == 1


# Runs


def brute_runs(w, least=24, periods=3):
    n, found = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, stop = i, j + q
            if j > i and stop - start >= max(least, periods * q) and not any(w[start : stop - r] == w[start + r : stop] for r in range(1, q)):
                found.append((start, stop - start, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_with_runs(seed):
    r = random.Random(seed)
    kind, n = r.randrange(6), r.choice([0, 1, 23, 24, 25, 80, 200])
    if kind == 0:
        return [r.choice("ab") for _ in range(n)]
    if kind == 1:
        base = [r.choice("abc") for _ in range(r.randint(1, 40))]
        return [r.choice("abc") for _ in range(9)] + [base[i % len(base)] for i in range(n)] + [r.choice("abc") for _ in range(5)]
    if kind == 2:
        return ["a"] * n
    if kind == 3:  # runs inside the period of a run
        inner = [r.choice("ab") for _ in range(r.randint(1, 4))]
        return (([inner[i % len(inner)] for i in range(30)] + ["z"]) * 5)[:n]
    if kind == 4:
        return [f"w{r.randrange(60)}" for _ in range(n)]
    base = [f"w{r.randrange(300)}" for _ in range(50)]
    return base + base + base + ["end"] + base


def collapse(w, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_are_those_of_brute_force():
    for seed in range(150):
        texts = [words_with_runs(seed * 7 + k) for k in range(7)]
        names = {}
        flat = np.array([names.setdefault(x, len(names)) for t in texts for x in t], np.int64)
        got = [[] for _ in texts]
        for owner, *run in zip(*(x.tolist() for x in runs.runs_of(flat, np.array([len(t) for t in texts]))), strict=True):
            got[owner].append(tuple(run))
        assert got == [brute_runs(t) for t in texts], seed


def test_find_runs_over_documents(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 150)
    texts = [" \n".join(words_with_runs(s)) for s in range(40)] + [None, "", " \t ", "a " * 24, "a " * 23, "A a " * 12]
    ids = list(range(40)) + [None, 41, 41, 43, 44, 45]
    out = sorted(((r["id"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in runs.find_runs(docs_of(spark, texts, ids)).collect()), key=str)
    expected = []
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").split()
        found = brute_runs(w)
        expected.append((i, found, max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else None, collapse(w, found)))
    assert out == sorted(expected, key=str)
    assert runs.find_runs(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_long_texts_of_one_period(spark):
    text = " ".join(f"w{i % 7000}" for i in range(30000))
    row = runs.find_runs(docs_of(spark, [text, "a " * 20000])).orderBy("id").collect()
    assert [tuple(x) for x in row[0]["runs"]] == [(0, 30000, 7000)] and row[0]["collapsed"].count(" ") == 6999
    assert [tuple(x) for x in row[1]["runs"]] == [(0, 20000, 1)] and row[1]["collapsed"] == "a"


def test_query_of_runs_plants_and_finds(spark, tmp_path):
    texts = prose(5, 60, vocabulary=400, most=150) + [None, "", "a " * 30, "b"]
    docs_of(spark, texts).select("doc_id", "text", F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        found = brute_runs(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else None
        row = got[i]
        assert row["n_runs"] == len(found)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in found))
        assert row["collapsed_sha256"] == sha(collapse(w, found))
    assert planted >= 3 and sum(r["n_runs"] for r in got.values()) >= 2


# Decontamination


def brute_leaks(docs, items, window=10):
    out = []
    for text in docs:
        w, hit, by = terms_in(text), set(), set()
        for item, t in items:
            x = terms_in(t)
            k = min(len(x), window)
            wanted = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    by.add(item)
        out.append((len(w), len(hit), sorted(by)))
    return out


def leaky(seed=3):
    items = prose(seed, 12, vocabulary=500, most=40) + ["short one", "", None, "w1"]
    r = random.Random(seed)
    texts = []
    for text in prose(seed + 1, 60, vocabulary=500, most=90):
        w = text.split()
        for _ in range(r.randint(0, 2)):
            x = terms_in(r.choice(items))
            a = r.randint(0, max(len(x) - 1, 0))
            at = r.randint(0, len(w))
            w[at:at] = x[a : a + r.choice([5, 9, 10, 11, 40])]
        texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return texts + [None, "", "short! ONE", "ones short", " ".join(items[0].split() * 40), texts[0]], items


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 18), (40, 1 << 18), (64, 50)])
def test_leaks_are_those_of_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "BLOCK_WORDS", block)
    texts, items = leaky()
    got = {r["id"]: r for r in suffixes.find_leaks(docs_of(spark, texts), items_of(spark, items)).collect()}
    expected = brute_leaks(texts, [(100 + i, t) for i, t in enumerate(items)])
    assert len(got) == len(texts)
    for i, (n, hit, by) in enumerate(expected):
        assert (got[i]["n_words"], got[i]["n_hit"], sorted({m["item"] for m in got[i]["matches"]})) == (n, hit, by), i
        w = terms_in(texts[i])
        for m in got[i]["matches"]:  # verbatim, and as long as it goes
            x = terms_in(items[m["item"] - 100])
            a, b, k = m["start"], m["item_start"], m["length"]
            assert w[a : a + k] == x[b : b + k]
            assert a == 0 or b == 0 or w[a - 1] != x[b - 1]
            assert a + k == len(w) or b + k == len(x) or w[a + k] != x[b + k]
    assert sum(bool(hit) for _, hit, _ in expected) > 10


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 100)

    def pieces(text):
        words = text.split()
        return [words[i : i + 7] for i in range(0, len(words), 7)]

    monkeypatch.setattr(suffixes, "term_lists", pieces)
    item = " ".join(f"q{i}" for i in range(30))
    texts = [" ".join(f"z{i}" for i in range(n)) + " " + item + " tail" for n in (0, 60, 85, 95, 99, 100, 101, 190, 195, 260)]
    expected = brute_leaks(texts, [(100, item)])
    got = {r["id"]: r for r in suffixes.find_leaks(docs_of(spark, texts), items_of(spark, [item])).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], len(got[i]["matches"])) for i in range(len(texts))] == [(n, hit, 1) for n, hit, _ in expected]


def test_suffix_arrays_are_sorted():
    r = random.Random(4)
    for _ in range(100):
        words = np.array([r.randrange(r.choice([1, 3, 2000])) for _ in range(r.randint(1, 150))], np.int64)
        depth = r.randint(1, 30)
        order = suffixes.suffix_array(words, depth).tolist()
        keys = [words[i : i + depth].tolist() for i in order]
        assert sorted(order) == list(range(len(words))) and keys == sorted(keys)


def test_removal_keeps_columns_and_clean_rows(spark):
    texts, items = leaky()
    docs = docs_of(spark, texts, [None if i % 9 == 0 else i // 2 for i in range(len(texts))])
    kept = suffixes.remove_leaks(docs, items_of(spark, items))
    clean = [t for t, (_, hit, _) in zip(texts, brute_leaks(texts, [(0, t) for t in items]), strict=True) if not hit]
    assert kept.columns == docs.columns
    assert sorted((r["text"] for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert suffixes.remove_leaks(docs, items_of(spark, items).limit(0)).count() == len(texts)
    assert suffixes.find_leaks(docs.limit(0), items_of(spark, items)).count() == 0
