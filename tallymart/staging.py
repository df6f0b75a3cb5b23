"""Intermediate tables that cut lineage, kept where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is set, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tallymart-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path under the shared folder; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, label: str, rows_a_group: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cache the copy survives lost executors, and its size is known to
    the planner of whatever reads it. The folder goes when the session ends.
    Writer and reader hold a group of rows at a time, so tables whose rows are
    megabytes need ``rows_a_group``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    limit = {"parquet.block.row.count.limit": str(rows_a_group)} if rows_a_group else {}
    df.write.mode("overwrite").options(**limit).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(name)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
