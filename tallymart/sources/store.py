"""Small tables that are replaced as a whole, and large ones that grow by rounds of rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators import incremental


def _by_all(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """An order of rows with equal keys that does not depend on where they are; maps have none."""
    return [F.to_json(F.struct(f"`{c}`")) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in df.columns if c not in keys]


class Rounds:
    """Rows in the folder of the round that wrote them, ``round=<number>``, with Spark's own writer.

    A round counts once Spark has marked its folder as complete. A name has one
    round: written again before that, it takes the place of what was left of
    it; afterwards it is left alone. So a batch that is tried again changes
    nothing, a round costs what it brings, and readers see all of it or none.
    """

    NUMBER = "round"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _started(self) -> dict[str, str]:
        """Folder by name of every round, complete or not, in their order."""
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return {f.split("-", 1)[1]: f for f in found if f.startswith("r") and "-" in f}

    def _complete(self) -> dict[str, str]:
        return {name: f for name, f in self._started().items() if self._fs.exists(self._path(f"{f}/_SUCCESS"))}

    def holds(self, name: str) -> bool:
        return name in self._complete()

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of round ``name``, written now if it is not complete."""
        if not self.holds(name):
            started = self._started()
            folder = started.get(name) or f"r{1 + max((int(f[1:].split('-')[0]) for f in started.values()), default=-1):012d}-{name}"
            number = int(folder[1:].split("-")[0])
            df.withColumn(self.NUMBER, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{folder}")
        return self.of(name)

    def of(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._complete()[name]}")

    def read(self) -> DataFrame | None:
        """All rows of complete rounds; None before the first."""
        folders = [f"{self.folder}/{f}" for f in self._complete().values()]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def latest(self, key: str) -> DataFrame | None:
        """The row of each key that the newest round wrote; a round writes a key once."""
        rows = self.read()
        if rows is None:
            return None
        newest = rows.groupBy(F.col(key).alias("__key")).agg(F.max(self.NUMBER).alias("__round"))
        return rows.join(newest, F.col(key).eqNullSafe(F.col("__key")) & (F.col(self.NUMBER) == F.col("__round"))).select(*rows.columns)

    def fold(self, key: str, name: str) -> None:
        """Put the latest rows into one round and delete those before it; for quiet times, when nobody reads."""
        before = [f for n, f in self._started().items() if n != name]
        self.put(name, self.latest(key))
        for folder in before:
            self._fs.delete(self._path(folder), True)


class Store:
    """A table in a folder that Spark can write; one writer at a time.

    A change writes a new version and then a pointer beside it, whose name
    sorts after the last, so readers see the old or the new table and never a
    part of one. Versions up to the one before the current stay.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _pointers(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("at-"))

    def exists(self) -> bool:
        return bool(self._pointers())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._current()}")

    def _current(self) -> str:
        return self._pointers()[-1].split("-", 2)[2]

    def replace(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        version, before = f"v{uuid.uuid4().hex}", self._pointers()
        df.write.partitionBy(*partition_by).parquet(f"{self.folder}/{version}") if partition_by else df.write.parquet(f"{self.folder}/{version}")
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        self._fs.create(self._path(f"at-{number:012d}-{version}"), False).close()
        for old in before[:-1]:
            self._fs.delete(self._path(old.split("-", 2)[2]), True)
            self._fs.delete(self._path(old), False)
        return self.read()

    def append(self, df: DataFrame) -> DataFrame:
        """Add the files of ``df`` to the current version; only rows with new columns rewrite the table."""
        if not self.exists():
            return self.replace(df)
        now = self.read()
        if set(df.columns) - set(now.columns):
            return self.replace(now.unionByName(df, allowMissingColumns=True))
        whole = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in now.schema if f.name not in df.columns})
        whole.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in now.schema]).write.mode("append").parquet(f"{self.folder}/{self._current()}")
        return self.read()

    def upsert(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
        """``df`` in the place of rows with its keys; of equal keys in ``df`` the first by ``order``, then by all columns."""
        tie = [*order, *_by_all(df, keys)]
        if not self.exists():
            return self.replace(incremental.first_of(df, keys, tie))
        return self.replace(incremental.upserted(self.read(), df, keys, tie))

    def insert_new(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Append rows with new keys and return just those; of equal ones the first by all columns."""
        fresh = incremental.first_of(df, keys, _by_all(df, keys) or [F.lit(1)])
        if self.exists():
            fresh = fresh.join(self.read().select(*keys), list(keys), "left_anti")
        staged = Store(self.spark, f"{self.folder}/.fresh").replace(fresh)
        self.append(staged)
        return staged

    def delete(self, condition: Column) -> DataFrame:
        return self.replace(self.read().filter(~F.coalesce(condition, F.lit(False))))

    def update(self, condition: Column, values: dict[str, Column]) -> DataFrame:
        now = self.read()
        return self.replace(now.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))


def check_valid(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = (), checks: dict[str, Column] | None = None) -> dict[str, int]:
    """Rows that break each constraint, those with none left out: keys that repeat, nulls, and failed checks."""
    found = {}
    if unique:
        found["unique " + ",".join(unique)] = df.groupBy(*unique).count().filter("count > 1").count()
    tests = {**{f"null {c}": F.col(c).isNull() for c in not_null}, **{name: ~c for name, c in (checks or {}).items()}}
    if tests:
        counted = df.agg(*[F.count_if(c).alias(name) for name, c in tests.items()]).first()
        found.update(counted.asDict())
    return {name: n for name, n in found.items() if n}
