"""The pipeline against a plain version of its five stages."""

from __future__ import annotations

import collections
import random
import re
from hashlib import md5, sha256

import numpy as np
import public_tokenizers
import sentencepiece

from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import line_dedup, mixing


def fixture(spark, folder):
    random.seed(21)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(160):
        lines = [" ".join(random.choice(vocabulary) for _ in range(random.randint(8, 25))) for _ in range(random.randint(1, 4))]
        if i % 4 == 0:
            lines.append("shared footer of this source")
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}"))
    rows += [(200 + k, rows[k][1] + " tail", "en", "src0") for k in range(0, 30, 3)]
    rows += [(300, "too short", "en", "src1"), (301, "again and again " * 40, "en", None), (302, None, "en", "src1"), (303, rows[7][1], "de", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return [(r[0], r[1], r[3]) for r in rows]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def passes(t):
    w = words(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    inside = {k for i, x in enumerate(windows) if times[x] > 1 for k in range(i, i + 8)}
    return len(w) >= 20 and 100 * len(inside) <= 30 * len(w)


def without_boilerplate(rows):
    pages, holders = collections.Counter(s for _, _, s in rows), collections.Counter()
    for _, t, s in rows:
        holders.update({(s, line) for line in t.split("\n") if words(line)})
    gone = {k for k, n in holders.items() if n >= line_dedup.MIN_PAGES and n > pages[k[0]] * line_dedup.RATIO}
    return [(i, "\n".join(line for line in t.split("\n") if (s, line) not in gone), s) for i, t, s in rows]


def one_of_each_group(rows):
    sets = {}
    for i, t, _ in rows:
        w = words(t.lower())
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return [r for r in rows if group[r[0]] == r[0]]


def copies(rows):
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in sources}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] >= 2 * size[s]}
        if not more:
            break
        full |= more
    taken = {}
    for s in sources:
        target, at = 2 * size[s] if s in full else level * weight[s], 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: md5(str(r[0]).encode()).hexdigest()):
            n = len(words(t))
            taken[i] = sum(at + n / 2 + k * size[s] <= target for k in (0, 1))
            at += n
    return taken


def test_run_equals_the_plain_version(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = one_of_each_group(without_boilerplate([r for r in fixture(spark, folder) if passes(r[1])]))
    wanted = collections.Counter()
    library, texts = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), {i: t for i, t, _ in rows}
    for i, n in copies(rows).items():
        ids = [1, *library.encode(texts[i]), 2]
        wanted[(i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())] += n
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +wanted and len(got) > 60


def test_rows_keep_the_order_of_the_mix(spark, tmp_path):
    """Positions of the last stage are the order that the mix gives, however files are packed into tasks."""
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    mixed = corpus_pipeline.source_mixing(spark, docs, folder)
    mixed.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id", F.desc("text")).write.parquet(f"{folder}/mixed")
    wanted = [r.doc_id for r in spark.read.parquet(f"{folder}/mixed").orderBy("doc_id").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = corpus_pipeline.tokenization(spark, spark.read.parquet(f"{folder}/mixed"), folder).select("position", "doc_id").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.doc_id for r in sorted(got)] == wanted and sorted(r.position for r in got) == list(range(len(wanted)))
    plan = mixing.plan_mix(docs).select("doc_id", F.explode("positions").alias("at")).orderBy("at", "doc_id").collect()
    mixed.write.parquet(f"{folder}/again")
    rows = corpus_pipeline.tokenization(spark, spark.read.parquet(f"{folder}/again"), folder).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in plan]
    loose = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.position for r in corpus_pipeline.tokenization(spark, loose, folder).collect()] == [None]


ODD = "doc_id long, text string, lang string, source string, n_chars long, __tm_row string, id string, kept string"


def test_stages_on_null_ids_and_repeated_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    random.seed(4)
    prose = lambda: " ".join(f"v{random.randrange(5000)}" for _ in range(40))
    a, b, c = prose(), prose(), prose()
    rows = [(None, a), (1, a), (1, a), (None, b), (None, b), (2, "short"), (None, "short"), (2, c), (None, None), (3, ""), (4, a + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "r", "x", "k") for i, t in rows], ODD)
    key = lambda found: sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in found.collect()))
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    assert key(kept) == sorted([(-1, a), (1, a), (1, a), (-1, b), (-1, b), (2, c), (4, a + " end")])
    assert key(corpus_pipeline.near_duplicates(spark, docs, folder)) == sorted([(1, a), (-1, b), (2, "short"), (2, c), (-1, ""), (3, "")])
    mixed = corpus_pipeline.source_mixing(spark, docs, folder)
    assert mixed.count() >= 10 and set(key(mixed)) <= set(key(docs))
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns
        assert step(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.tokenization(spark, docs, folder).count() == len(rows) and corpus_pipeline.tokenization(spark, docs.limit(0), folder).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
