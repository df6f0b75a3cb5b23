"""From raw documents to tokenised training order, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes what each returns to the shared folder and gives it to the next. All
but the last return the columns of ``documents``. This file goes with the
subpackage ``tallymart.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import jaccard, line_dedup, mixing, pieces, quality
from tallymart.llm.queries import PIECE_MODEL
from tallymart.llm.rows import with_file_order, with_row_names
from tallymart.session import ship_package
from tallymart.sources import table
from tallymart.staging import stage, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified rules keep.

    Each row is judged by its own text and language: rows with a null id or an
    id that others have are kept or go by themselves, repeated rows together.
    A null text fails the base rules. An empty table stays empty.
    """
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text.

    Every row is a page of its source, repeated ones and those with null ids
    among them; a null source is a source of its own; a null text and an empty
    table stay what they are.
    """
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links join: the one with the least doc_id, null ids last, and of equal ids the first in the files.

    Repeated rows are copies of each other, so one stays. Documents without
    words are no copies and stay. An empty table stays empty.
    """
    ship_package(spark)
    rows, row = with_row_names(docs)
    found = jaccard.jaccard_components(rows, id_col=row).filter("n_shingles > 0").select(F.col("id").alias(row), "component_id")
    named = stage(found.join(rows.select(row, "doc_id"), row), "named")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    best = named.groupBy("component_id").agg(least.alias("best")).select(F.col("best.row").alias(row))
    gone = stage(named.select(row).join(best, row, "left_anti"), "gone")
    unstage(named)
    unstage(found)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order that the mix takes them; a document taken twice is two rows.

    Rows are told apart whatever their ids are. Ties of position go by the
    order of rows. An empty table stays empty.
    """
    return mixing.mix(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: its ``position`` in training order, ids of the whole text, their number, and digests of ids, decoded text and spans.

    The position is the row's place in the files that the mix was written to,
    in its order; null for rows that do not come from files. Null and empty
    texts have begin and end ids alone.
    """
    ship_package(spark)
    placed = with_file_order(docs, "position")
    return pieces.encode_and_decode(placed, PIECE_MODEL, with_ids=True, also=["position"]).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the last one's rows. What a stage returned goes as soon as the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the exact binomial bounds nor the encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
