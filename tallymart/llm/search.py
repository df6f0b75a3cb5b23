"""Ranked lexical search by scoring windows of documents with one array each."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tallymart.llm.terms import Numbers, query_blocks, ranges, term_lists, terms, type_of
from tallymart.llm.words import prefer_small_batches, texts_as_bytes
from tallymart.staging import stage

#: Documents of a window, whose scores fit a core's cache; terms after which a window ends as well.
WINDOW, WINDOW_TERMS = 4096, 1 << 20
#: Terms of the queries that go to the tasks at once.
BLOCK_TERMS = 1 << 18
TOP = 50


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold a term as windows of at most ``WINDOW`` documents, one row a window.

    A window numbers its documents from 0 (``ids``, ``lengths``) and has the
    postings of its terms one after the other: ``sizes[t]`` entries of
    ``places`` and ``counts`` for ``terms[t]``, by document. Windows are made
    of what one task reads, so nothing is shuffled; only a single document can
    make one larger than its bounds.
    """
    prefer_small_batches(docs.sparkSession)
    id_type = type_of(docs, id_col)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"ids array<{id_type}>, lengths array<long>, terms array<string>, sizes array<int>, places array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, numbers, keys, held = [], [], Numbers(), [], 0

        def window(kind: pa.DataType) -> pa.RecordBatch:
            key, counts = np.unique(np.concatenate(keys), return_counts=True)
            sizes = np.bincount(key >> 32, minlength=len(numbers))
            values = (pa.array(ids, kind), pa.array(lengths, pa.int64()), pa.array(list(numbers), pa.binary()).cast(pa.string()), *(pa.array(x.astype(np.int32)) for x in (sizes, key & 0xFFFFFFFF, counts)))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], names=["ids", "lengths", "terms", "sizes", "places", "counts"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                length = 0
                for some in term_lists(text or b""):
                    if some:
                        keys.append(numbers.of(some) << 32 | len(ids))
                        length += len(some)
                if length:
                    ids.append(name)
                    lengths.append(length)
                    held += length
                if len(ids) >= WINDOW or held >= WINDOW_TERMS:
                    yield window(kind)
                    ids, lengths, numbers, keys, held = [], [], Numbers(), [], 0
        if ids:
            yield window(kind)

    return chosen.mapInArrow(run, schema)


def stored_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a stored table that is written and read window by window, however many windows a task makes."""
    return stage(build_index(docs, id_col, text_col), "windows", rows_a_group=1)


class _Best:
    """A query's best documents so far, out of a heap of at most ``top``."""

    def __init__(self, top: int) -> None:
        self.top, self.least, self.rows = top, 1, []

    def offer(self, scores: np.ndarray, places: np.ndarray, ids: pa.Array) -> None:
        near = np.flatnonzero(scores >= self.least)
        if len(near) > self.top:
            near = near[scores[near] >= np.partition(scores[near], -self.top)[-self.top]]
        if not len(near):
            return
        names = ids.take(pa.array(places[near])).to_pylist()
        self.rows = heapq.nsmallest(self.top, [*self.rows, *zip((-scores[near]).tolist(), ((n is None, n) for n in names), strict=True)])
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


def _scored(index: DataFrame, block: list[Row], n_docs: int, n_terms: int, top: int, id_type: str, item_type: str) -> DataFrame:
    """The best documents of each task for each query of the block."""
    numbers = Numbers()
    queries = [(numbers.of([x["term"] for x in q["weighted"]]), np.array([x["weight"] for x in q["weighted"]], np.int64)) for q in block]
    names, vocabulary = [q["item"] for q in block], list(numbers)
    weights = np.zeros(len(vocabulary), np.int64)
    for which, weight in queries:
        weights[which] = weight
    asked = [which for which, _ in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best, kind = pa.array(vocabulary, pa.string()), [_Best(top) for _ in asked], None
        scores, occupied = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, own, sizes, places, counts = (batch.column(c)[row].values for c in range(6))
                kind = ids.type
                found = pc.index_in(wanted, value_set=own)
                known, at = np.asarray(found.is_valid()), found.fill_null(0).to_numpy()
                ends = np.cumsum(sizes.to_numpy(), dtype=np.int64)
                begins = np.where(known, ends[at] - sizes.to_numpy()[at], 0)
                ends = np.where(known, ends[at], 0)
                which = ranges(begins, ends)
                place, count = places.to_numpy()[which], counts.to_numpy()[which].astype(np.int64)
                long = 50 + 50 * lengths.to_numpy() * n_docs // n_terms
                points = np.repeat(weights, ends - begins) * (1_000_000_000 * count // (1000 * count + 20 * long[place]))
                stops = np.cumsum(ends - begins)
                starts = stops - (ends - begins)
                if len(ids) > len(scores):
                    scores, occupied = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for query, heap in zip(asked, best, strict=True):
                    for t in query[known[query]]:
                        here = place[starts[t] : stops[t]]
                        scores[here] += points[starts[t] : stops[t]]
                        occupied[here] = True
                    hit = np.flatnonzero(occupied)
                    heap.offer(scores[hit], hit, ids)
                    scores[hit] = 0
                    occupied[hit] = False
        rows = [(q, -score, name) for q, heap in enumerate(best) for score, (_, name) in heap.rows]
        if rows:
            which, points, found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"query": pa.array(which, pa.int32()), "score": pa.array(points, pa.int64()), "id": pa.array(found, kind)})

    found = index.mapInArrow(run, f"query int, score long, id {id_type}")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    items = index.sparkSession.createDataFrame(list(enumerate(names)), f"query int, item {item_type}")
    return ranked.join(items, "query").select("item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item, rank (from 1), id, score.

    Windowed bucket scoring. The index is written once; each task then goes
    through its windows, and for each item through the postings of its terms,
    adding points into an array of the window's documents and marking the
    occupied places; only those are harvested, into a heap an item, which stays
    over all windows of the task. A last step ranks the heaps of all tasks.
    The items go to the tasks in blocks of at most ``BLOCK_TERMS`` terms.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its points in a
    document weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L).
    Each row of either table counts by itself, so ids may repeat; equal scores
    go by ascending id, null last. Texts that are null or without terms find
    nothing and are not found; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    id_type, item_type = type_of(docs, id_col), type_of(items, item_col)
    index = stored_index(docs, id_col, text_col)
    totals = index.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    keyed = items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item"), F.array_distinct(terms(F.col(item_text))).alias("held"))
    pairs = keyed.select("key", "item", F.explode("held").alias("term"))
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").cast("long").alias("df"))
    df = held.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    queries = pairs.join(df, "term").groupBy("key", "item").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("weighted"))
    found = [_scored(index, block, n_docs, n_terms, top, id_type, item_type) for block in query_blocks(queries, lambda q: len(q["weighted"]), BLOCK_TERMS)]
    if not found:
        return spark.createDataFrame([], f"item {item_type}, rank int, id {id_type}, score long")
    if len(found) > 1:
        found = [stage(f, "ranked") for f in found]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
