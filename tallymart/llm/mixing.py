"""Mixing sources to target weights along a curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.rows import free_name, with_row_names
from tallymart.staging import stage

#: Weights of the sources in code-point order (null last), repeating; words wanted over words there; times a source may be read.
WEIGHTS, BUDGET, MOST_REPEATS = (5, 2, 1), 1.5, 2
#: Change of a source's weight over training: its rate at time t in 0..1 is 1 + TILT * (2t - 1), with tilts dealt like the weights.
TILTS = (0.5, 0.0, -0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, tilts: Sequence[float] = TILTS) -> DataFrame:
    """``(key, source_size, target, tilt)`` per source of ``sized`` (source, key, size).

    A target is the common level times the source's weight, or ``most`` times
    its size where that is less; the level is found by sorting sources by the
    level at which each is full. That window runs over one row a source in one
    task, after sizes have been summed up for each source in parts.
    """
    def dealt(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((F.col("nth") - 1) % len(values) + 1).cast("int"))

    sources = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    ordered = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ordered = ordered.withColumns({"weight": dealt(weights), "tilt": dealt(tilts), "cap": F.col("source_size") * float(most), "total": F.sum("source_size").over(every) * float(budget)})
    fills = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth"))
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = ordered.withColumn("full", F.col("cap") / F.col("weight") <= level)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return full.withColumns({"rest": rest, "free": free}).select("key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("rest") / F.col("free")).alias("target"), "tilt")


def _time(demand: Column, tilt: Column) -> Column:
    """When a source has had the share ``demand`` of its target: t + tilt * (t * t - t) = demand, solved for t."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * demand)
    return F.when(tilt == 0, demand).otherwise((root - (1 - tilt)) / (2 * F.when(tilt == 0, 1.0).otherwise(tilt)))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, tilts: Sequence[float] = TILTS) -> DataFrame:
    """How often and when each document is read.

    Per row of ``df``: ``id_col``, ``size`` (words), ``source_size``,
    ``target``, ``copies``, ``taken`` (size times copies) and ``positions``,
    one time in 0..1 for each copy, ascending. A source's documents stand in
    the order of md5(id); a copy is taken while its middle lies within the
    target, so a source's taken words miss its target by half a document at
    most. Rows with a null text have size 0, a null source is the last source,
    rows with equal ids follow each other, and a null id counts as ''. An
    empty table gives an empty plan.
    """
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "positions"]
    return _planned(df, id_col, text_col, source_col, weights, budget, most, tilts).select(*columns)


def _planned(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], budget: float, most: int, tilts: Sequence[float], row: Column | None = None) -> DataFrame:
    """The plan with ``id`` and ``row``, the number of the row where it is given.

    Running sums go over 4096 hash buckets of each source and then within each
    bucket, so no task holds a whole source.
    """
    row = F.lit(0).cast("long") if row is None else row
    sized = df.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _key(source_col).alias("key"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("turn"))
    sized = stage(sized.withColumn("bucket", F.substring("turn", 1, 3)), "sizes")  # as long as the plan is read
    buckets = sized.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(targets(sized, weights, budget, most, tilts), "key").drop("bucket_size")
    within = Window.partitionBy("key", "bucket").orderBy("turn", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["key", "bucket"]).withColumn("middle", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2)
    middles = F.array(*[F.col("middle") + F.col("source_size") * float(i) for i in range(most)])
    taken = F.filter(middles, lambda m: m <= F.col("target"))
    share = lambda m: F.when(F.col("target") > 0, m / F.when(F.col("target") > 0, F.col("target")).otherwise(1.0)).otherwise(0.0)
    out = placed.withColumn("taken_at", taken)
    return out.select("row", "id", "size", "source_size", "target", F.size("taken_at").cast("long").alias("copies"), F.transform("taken_at", lambda m: _time(share(m), F.col("tilt"))).alias("positions"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS, tilts: Sequence[float] = TILTS
) -> DataFrame:
    """``df`` as it is trained on: each row as often as planned, range-sorted by position.

    Rows have a number each (see ``with_row_names``) and meet their plan by it,
    so ids and texts may repeat or be null. Rows that the plan does not take are left
    out; an empty table stays empty; other columns, whatever they are called,
    are kept.
    """
    rows, row = with_row_names(df)
    plan = stage(_planned(rows, id_col, text_col, source_col, weights, budget, most, tilts, F.col(row)), "plan")
    name, position = free_name(rows, "__tm_asked"), free_name(rows, "__tm_position")
    asked = plan.filter("copies > 0").select(F.col("row").alias(name), F.explode("positions").alias(position))
    met = rows.join(asked, rows[row] == asked[name])
    return met.orderBy(position, row).select(*[F.col(f"`{c}`") for c in df.columns])
