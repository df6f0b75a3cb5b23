"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallymart.llm.rows import with_row_names
from tallymart.llm.words import SPACES, WordHashes, prefer_small_batches, texts_as_bytes, window_hashes
from tallymart.staging import stage, unstage

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = SPACES + bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

#: Rejected share of good documents that a stratum's rules may reach together, and the chance that one does after all.
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs of each rule from lenient to strict; a rule rejects a value above its cutoff. Level n of all rules is their n-th cutoffs together.
CUTOFFS = {
    "symbols": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeats": (0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
    "long_words": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
    "short_words": (0.6, 0.55, 0.5, 0.45, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32),
    "capitals": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "bangs": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
LEVELS = len(CUTOFFS["symbols"])


def measures_of(text: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    """MEASURES of one text. A repeated word lies in a window of 8 words that the text holds twice or more."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > WINDOW:
        windows = window_hashes(hashes.of(words), WINDOW)
        distinct, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        if len(distinct) < len(windows):
            starts = np.flatnonzero(count[back] > 1)
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + WINDOW, -1)
            repeated = int((np.cumsum(change) > 0).sum())
    size = len(text)
    return n, len(text.translate(None, _NOT_CHARS)), size - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), size - len(text.translate(None, _UPPER)), text.count(b"!")


def _measured(rows: DataFrame, kept: int) -> DataFrame:
    """The first ``kept`` columns of ``rows``, whose last is a text, with the MEASURES of that text."""
    prefer_small_batches(rows.sparkSession)
    names = [*rows.columns[:kept], *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = np.array([measures_of(t, hashes) for t in texts_as_bytes(batch.column(batch.num_columns - 1))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.array(made[:, i]) for i in range(len(MEASURES))]], names)

    schema = StructType([*rows.schema.fields[:kept], *[StructField(m, LongType()) for m in MEASURES]])
    return rows.mapInArrow(run, schema)


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("stratum")


def _text_key(column: str) -> Column:
    """64 bits that name a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("text_key")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(id, stratum, text_key, *MEASURES)`` for each row, over its whole text.

    A null or empty text has no words and all measures 0; repeated rows give
    repeated rows; a null stratum is the stratum ``""``; an empty table gives
    no rows.
    """
    return _measured(df.select(F.col(id_col).cast("long").alias("id"), _stratum(stratum_col), _text_key(text_col), F.col(text_col).alias("text")), 3)


def _features() -> dict[str, Column]:
    def share(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)

    return {
        "symbols": share(F.col("n_symbols"), "word_chars"),
        "dup_lines": share(F.col("n_dup_lines"), "n_lines"),
        "repeats": share(F.col("n_repeat_words"), "n_words"),
        "long_words": share(F.col("word_chars"), "n_words"),
        "short_words": share(F.col("n_words"), "word_chars"),
        "capitals": share(F.col("n_upper"), "word_chars"),
        "bangs": share(F.col("n_bangs"), "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def upper_bound(rejected: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound on a share of which ``rejected`` of ``n`` were seen, wrong with chance ``delta``."""
    if n <= 0 or rejected >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(rejected + 1)]

    def at_most(p: float) -> float:
        return sum(math.exp(t + i * math.log(p) + (n - i) * math.log1p(-p)) for i, t in enumerate(terms))

    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if 0 < p < 1 and at_most(p) <= delta:
            high = p
        else:
            low = p
    return high


def strictness() -> Column:
    """The most cutoffs of any one rule that a document's value exceeds: level n rejects those that exceed LEVELS + 1 - n or more."""
    def exceeded(value: Column, cutoffs: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda cutoff: value > cutoff))

    features = _features()
    return F.greatest(*[exceeded(features[rule], cutoffs) for rule, cutoffs in CUTOFFS.items()])


def calibrate(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, level, n_good, rejected, bound)``: the strictest level certified per stratum.

    Good documents are those labelled 1 by all their labels. A labelled id is
    one trial, however many rows it has, and equal texts of a stratum are one
    trial, whatever their ids: copies are no new evidence, so repeating rows
    certifies nothing more. Where rows of a trial differ, the strictest
    judgement counts. At a level every
    rule has its cutoff of that level, and a document is rejected if it
    exceeds any of them, so the rules share one test and not one budget each:
    with no good document rejected, ln(strata / delta) / alpha good ones
    certify a level. Levels are tested from lenient to strict and testing
    stops at the first whose exact upper bound exceeds ``alpha``, a fixed
    sequence that needs no further correction; ``delta`` is shared among
    strata (Bonferroni). Documents whose base rules fail are not the rules' to
    reject and do not count. A stratum without a certified level does not
    appear; without labels none does. Only counts, a row for each stratum and
    strictness, leave the aggregation.
    """
    good = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(quality_col).alias("q")).filter(F.col("q") == 1).select("id")
    labelled = measured.filter(~base_failed()).join(good, "id", "left_semi").select("id", "stratum", "text_key", strictness().alias("above"))
    by_id = labelled.groupBy("id").agg(F.min(F.struct("stratum", "text_key")).alias("of"), F.max("above").alias("above"))
    held = by_id.groupBy("of.stratum", "of.text_key").agg(F.max("above").alias("above"))
    counts = stage(held.groupBy("stratum", "above").agg(F.count("*").alias("n")), "counts")
    n_strata = counts.select("stratum").distinct().count()

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        n, best = int(pdf["n"].sum()), []
        for level in range(1, LEVELS + 1):
            rejected = int(pdf.loc[pdf["above"] > LEVELS - level, "n"].sum())
            bound = upper_bound(rejected, n, delta / n_strata)
            if bound > alpha:
                break
            best = [(pdf["stratum"].iloc[0], level, n, rejected, bound)]
        return pd.DataFrame(best, columns=["stratum", "level", "n_good", "rejected", "bound"])

    return counts.groupBy("stratum").applyInPandas(certify, "stratum string, level int, n_good long, rejected long, bound double")


def judge(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: base rules, then the stratum's certified level."""
    levels = thresholds.select("stratum", F.col("level").alias("__tm_level"))
    broken = strictness() > LEVELS - F.coalesce("__tm_level", F.lit(0))
    return measured.join(levels, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | broken)).drop("__tm_level")


def assess(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(id, stratum, *MEASURES, base_failed, kept)`` for each row of ``df``.

    Texts are measured once; the narrow measures are written and reread. See
    ``measure`` and ``calibrate`` for nulls, repeated rows, empty tables and
    missing labels.
    """
    measured = stage(measure(df, id_col, text_col, stratum_col), "measures")
    return judge(measured, stage(calibrate(measured, labels, alpha=alpha, delta=delta), "levels")).drop("text_key")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``df`` that ``assess`` keeps, with all their columns.

    Each row is judged by itself, by its number (see ``with_row_names``):
    repeated rows share their fate, and a null id or one that several rows
    have makes no difference, except that labels are met by id.
    """
    rows, row = with_row_names(df)
    picked = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), _stratum(stratum_col), _text_key(text_col), F.col(text_col).alias("text"))
    measured = stage(_measured(picked, 4), "measures")
    levels = stage(calibrate(measured, labels, alpha=alpha, delta=delta), "levels")
    gone = stage(judge(measured, levels).filter("not kept").select(F.col("row").alias(row)), "gone")
    unstage(measured)
    unstage(levels)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
