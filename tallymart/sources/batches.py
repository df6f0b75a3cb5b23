"""Tables that grow by batches, with Spark's own writer: a partition for each batch, and a ledger of those that count."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "published"


def _there(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def publish(spark: SparkSession, folder: str, batch: str, tables: Mapping[str, DataFrame]) -> None:
    """Write the rows of every table as partition ``batch``, then enter the batch into the ledger.

    Readers see the rows of all tables from then on and none of them before.
    A batch written again takes the place of what it had written, so one that
    failed half-way, or is tried again, leaves no rows twice.
    """
    for name, rows in tables.items():
        rows.drop("batch").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    spark.range(1).select(F.lit(True).alias("whole")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LEDGER}/batch={batch}")


def published(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches in the ledger, with their ``batch``; none before the first. ``schema`` leaves ``batch`` out."""
    typed = spark.createDataFrame([], schema).withColumn("batch", F.lit("")) if not (_there(spark, f"{folder}/{LEDGER}") and _there(spark, f"{folder}/{name}")) else None
    if typed is not None:
        return typed
    whole = StructType([*(spark.createDataFrame([], schema).schema), *spark.createDataFrame([], "batch string").schema])
    rows = spark.read.schema(whole).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    ledger = spark.read.schema("whole boolean, batch string").option("basePath", f"{folder}/{LEDGER}").parquet(f"{folder}/{LEDGER}")
    return rows.join(ledger.select("batch").distinct(), "batch", "left_semi").select(*whole.fieldNames())


def is_published(spark: SparkSession, folder: str, batch: str) -> bool:
    return _there(spark, f"{folder}/{LEDGER}/batch={batch}/_SUCCESS")
