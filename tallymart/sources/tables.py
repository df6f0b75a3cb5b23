"""Named tables of a data directory, read with Spark so that any store Spark knows works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``data_dir``."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
