"""Nearest neighbours by largest inner product through a permutation index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.staging import stage

#: Pivots, at most and as a share of the vectors; pivots that a vector is posted under; pivots that a query asks.
PIVOTS, VECTORS_A_PIVOT, POSTED, ASKED = 128, 16, 10, 16
#: Nearest pivots of the query that the footrule looks at; share and least number of a posting list that is reranked.
COMPARED, RERANKED, LEAST = 24, 0.3, 200
#: Vectors and queries that meet in one task at most; a list that is asked by more queries is copied once for each further block of them.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 8192


def _valid(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a component more that makes all as long as the longest: then the nearest has the largest inner product."""
    short = np.sqrt(np.maximum(longest**2 - (rows**2).sum(axis=1), 0.0))
    return np.hstack([rows, short[:, None]])


def _places(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of each row from the nearest, and each pivot's place in that order."""
    order = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return order, place


def _post(classes: DataFrame, pivots: np.ndarray, longest: float, under: int, query: bool, kind: str) -> DataFrame:
    """``(pivot, class, place, vector)``: a row for each of the ``under`` pivots nearest to a vector, whose components are of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            lifted = np.hstack([rows, np.zeros((len(rows), 1))]) if query else _lifted(rows, longest)
            order, place = _places(lifted, pivots)
            take = np.repeat(np.arange(len(rows)), under)
            binary = [pa.array([r.tobytes() for r in table], pa.binary()).take(pa.array(take)) for table in (place, rows.astype(kind))]
            yield pa.RecordBatch.from_arrays([pa.array(order[:, :under].ravel().astype(np.int32)), batch.column(0).take(pa.array(take)), *binary], ["pivot", "class", "place", "vector"])

    return classes.select("class", "vector").mapInArrow(run, "pivot int, class long, place binary, vector binary")


def best_of_block(k: int, compared: int, share: float, least: int, of: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Queries against vectors of one block: a cut by footrule distance, equal ones by class, then exact inner products in double precision."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(table: pa.Table, column: str, kind: type | str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(column).to_pylist()), kind).reshape(table.num_rows, -1)

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("class")
            places, vectors, names = matrix(left, "place", np.uint8).T.astype(np.int16), matrix(left, "vector", of).astype(np.float64), left.column("class").to_numpy()
            asked, queries, asking = matrix(right, "place", np.uint8), matrix(right, "vector", of).astype(np.float64), right.column("class").to_numpy()
            keep = max(least, int(share * len(names)))
            for place, query, name in zip(asked, queries, asking, strict=True):
                some = slice(None)
                if len(names) > keep:
                    nearest = np.argsort(place, kind="stable")[:compared]
                    footrule = np.zeros(len(names), np.int64)
                    for at, pivot in enumerate(nearest):
                        footrule += np.abs(places[pivot] - at)
                    some = np.sort(np.argpartition(footrule * len(names) + np.arange(len(names)), keep)[:keep])
                scores = (vectors[some] * query).sum(axis=1)
                if len(scores) > k:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    top = np.flatnonzero(scores >= edge)
                else:
                    top = np.arange(len(scores))
                top = top[np.lexsort((names[some][top], -scores[top]))][:k]
                found.append((np.full(len(top), name), names[some][top], scores[top]))
        query, name, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query": query, "class": name, "score": score})

    return run


def _ask(postings: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """``(query, found)``: up to k classes and scores for each query class, over all blocks of the pivots it asks."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    counts = stage(blocks(postings, VECTOR_BLOCK, "blocks").join(blocks(queries, QUERY_BLOCK, "parts"), "pivot"), "blocks")
    one = lambda n: F.pmod(F.hash("class"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = postings.join(F.broadcast(counts), "pivot").withColumn("block", one("blocks")).withColumn("part", every("parts"))
    asking = queries.join(F.broadcast(counts), "pivot").withColumn("part", one("parts")).withColumn("block", every("blocks"))
    keys = ["pivot", "block", "part"]
    best = vectors.select(*keys, "class", "place", "vector").groupBy(*keys).cogroup(asking.select(*keys, "class", "place", "vector").groupBy(*keys)).applyInArrow(best_of_block(k, COMPARED, RERANKED, LEAST, kind), "query long, class long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return best.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("query", "class", "score")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the k rows with the largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``; a query is not
    its own neighbour. Ties go to the smaller id. With fewer than k other
    vectors all are returned. Vectors that are null, zero, of another length
    than most (inner products need one length), or hold null or non-finite
    components take no part; repeated rows count once an id; an empty table
    gives no rows. An id with several vectors is one query and one candidate,
    with the best product of any of them.

    Equal vectors are one class, of which the k + 1 smallest ids are kept. A
    class is named by its smallest id, or, where another class has that id,
    too, by a hash of its vector.
    Pivots are a bounded sample: the classes with the least hashes, PIVOTS at
    most. Every class is posted under its nearest pivots; a query asks its own
    nearest ones, ranks their lists by the footrule distance of the pivots'
    order and takes exact products of the best. A query that finds too few
    asks all pivots. Reruns agree: ties of footrule go by class.

    The number of pivots and the shares of lists that are asked and reranked
    do not shrink with n, so work grows with queries times vectors: among
    vectors without structure the nearest are found only by looking at a share
    of all. Lists are asked in blocks of both sides; vectors stand beside
    their places there, as a share of each list is reranked.
    """
    sized = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sized["dim"] if sized else 1
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    vector = F.col(vector_col).cast("array<double>")
    valid = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & _valid(F.col("vector"), dim))
    keyed = valid.withColumns({"h": F.xxhash64(F.lit(1), "vector"), "g": F.xxhash64(F.lit(2), "vector")})
    smallest = Window.partitionBy("h", "g").orderBy("id")
    classes = keyed.withColumn("nth", F.dense_rank().over(smallest)).filter(F.col("nth") <= k + 1).groupBy("h", "g").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("vector").alias("vector"))
    first = F.element_at("ids", 1)
    named = F.row_number().over(Window.partitionBy(first).orderBy("h", "g"))
    classes = stage(classes.withColumn("class", F.when(named == 1, first).otherwise(F.xxhash64("h", "g"))), "classes")
    several = keyed.select("id", "h", "g").distinct().groupBy("id").count().agg(F.max("count")).first()[0] or 1
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asking = stage(keyed.filter(F.col("id") % every == 0).select("id", "h", "g").distinct().join(classes.select("h", "g", "class"), ["h", "g"]).select(F.col("id").alias("query_id"), "class"), "asking")
    wanted = classes.join(asking.select("class").distinct(), "class", "left_semi")

    sample = classes.orderBy("h", "g").limit(min(PIVOTS, max(8, n // VECTORS_A_PIVOT))).select("vector").collect()
    pivots = _lifted(np.array([r["vector"] for r in sample], np.float64).reshape(len(sample), dim), longest or 0.0)
    postings = stage(_post(classes, pivots, longest or 0.0, min(POSTED, len(sample)), False, kind), "postings")
    most = (k + 1) * several
    found = stage(_gathered(_ask(postings, _post(wanted, pivots, longest or 0.0, min(ASKED, len(sample)), True, kind), most, kind), classes, k), "found")
    enough = min(k + 1, keyed.select("id").distinct().limit(k + 1).count())
    full = found.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
    few = wanted.join(full.select(F.col("query").alias("class")), "class", "left_anti")
    if len(sample) > ASKED and (few := stage(few, "few")).head(1):
        again = stage(_gathered(_ask(postings, _post(few, pivots, longest, len(sample), True, kind), most, kind), classes, k), "again")
        found = found.join(again.select("query").distinct(), "query", "left_anti").unionByName(again)
    met = asking.join(found, asking["class"] == found["query"]).filter(F.col("id") != F.col("query_id"))
    return _first(met.groupBy("query_id", "id").agg(F.max("score").alias("score")), "query_id", k).select("query_id", "rank", "id", "score")


def _first(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of the highest score for each key, with their rank; ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _gathered(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(query, id, score)``: the k + 1 best ids of the classes found, each once."""
    members = found.join(classes.select("class", "ids"), "class").select("query", F.explode("ids").alias("id"), "score")
    return _first(members.groupBy("query", "id").agg(F.max("score").alias("score")), "query", k + 1).drop("rank")
