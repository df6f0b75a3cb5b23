"""Names for rows that hold whatever their ids are: null, repeated or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.staging import stage


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def from_files(df: DataFrame) -> bool:
    """Whether ``df`` is a table of files just as it was read."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and bool(df.inputFiles())


def with_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, as read from Parquet files, with each row's place from 0 in the order in which it was written, as ``name``.

    Spark numbers the files of a sorted table in its order, and a row's number
    within its file does not depend on how files are packed into tasks. Only
    counts, one a file, are summed up in a window, and meet the rows in a join
    that their size decides. Rows that do not come straight from files have no
    such order: null.
    """
    if not from_files(df):
        return df.withColumn(name, F.lit(None).cast("long"))
    file, at, start = (free_name(df, f"__tm_{c}") for c in ("file", "at", "start"))
    number: Column = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    counts = df.select(F.col("_metadata.file_path").alias(file)).groupBy(file).agg(F.count("*").alias("rows"))
    before = Window.orderBy(number.asc_nulls_last(), file).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.withColumn(start, F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"), "starts")
    placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)).join(starts, file)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(start) + F.col(at)).alias(name))


def with_row_names(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for each row, the same whenever it is read, and the name of that column.

    A table of files has its places in the files as numbers; any other is
    written first.
    """
    name = free_name(df, "__tm_row")
    if from_files(df):
        return with_file_order(df, name), name
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name
