"""Look-backs over a stream of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inflow(stream: DataFrame, at: str = "found_at", key: str = "model", span: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Listings by key in sliding windows; rows later than the watermark are left out. Works on a batch, too."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(F.window(at, span, step).alias("w"), key).agg(F.count("*").alias("inflow")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "inflow")
