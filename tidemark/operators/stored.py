"""Tables that are written and written again: a keyed log of changes that is folded now and then, and partitions that are replaced and dropped by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folders(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values of the folders name=value below path whose writing has ended, in order of their text; none where path is missing."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(p.getName().partition("=")[2] for p in found if p.getName().startswith(f"{name}="))


def _ended(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class ChangeLog:
    """A keyed table as batches of changes, merged when it is read, and a base that batches are folded into.

    A change has the keys, ``op`` ('upsert' or 'delete'), the order columns and any other columns, nested ones too. An upsert sets the
    columns that are not null and leaves the others; a delete ends all that came before it in order. What counts is the order,
    not the batch: batches that come late, twice or in another sequence give the same table. Appending is one
    aggregate of the batch, so its cost does not grow with the table; ``compact`` folds base and batches into a new base
    and is due when reading many batches costs more. Deletes stay on record, for changes that come after them but
    precede them in order. Changes without a key or of another op are left out; without any change the table is empty.
    Two changes of one key must differ in their order, or which of them counts is undefined.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: StructType):
        self.spark, self.path, self.keys = spark, path, keys
        self.columns = [f.name for f in schema if f.name not in (*keys, *order, "op")]
        self.order = F.struct(*order)
        self.schema = self._fold(spark.createDataFrame([], schema)).schema

    def _fold(self, changes: DataFrame) -> DataFrame:
        """One state per key: its last delete, its last upsert, and each column's last value with its order."""
        known = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        upserts, deletes = F.when(F.col("op") == "upsert", self.order), F.when(F.col("op") == "delete", self.order)
        last = lambda c: F.max_by(F.struct(self.order.alias("at"), F.col(c).alias("value")), F.when(F.col(c).isNotNull(), upserts)).alias(c)
        return known.where("op IN ('upsert', 'delete')").groupBy(*self.keys).agg(F.max(deletes).alias("_gone"), F.max(upserts).alias("_last"), *map(last, self.columns))

    def _states(self) -> DataFrame:
        """Base and later batches, one state per key."""
        folded = self._folded()
        later = [f"{self.path}/log/batch={k}" for k in self._batches() if k > folded]
        paths = later + ([f"{self.path}/base/upto={folded}"] if folded >= 0 else [])
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        states = self.spark.read.schema(self.schema).parquet(*paths)
        return states.groupBy(*self.keys).agg(F.max("_gone").alias("_gone"), F.max("_last").alias("_last"), *[F.max_by(c, f"{c}.at").alias(c) for c in self.columns])

    def _batches(self) -> list[int]:
        return sorted(int(k) for k in folders(self.spark, f"{self.path}/log", "batch") if _ended(self.spark, f"{self.path}/log/batch={k}"))

    def _folded(self) -> int:
        """The last batch that the newest whole base holds; -1 without a base."""
        return max((int(k) for k in folders(self.spark, f"{self.path}/base", "upto") if _ended(self.spark, f"{self.path}/base/upto={k}")), default=-1)

    def append(self, batch: int, changes: DataFrame) -> None:
        """Write a batch. The same batch again replaces itself, or changes nothing if it is in the base."""
        if batch <= self._folded():
            return
        self._fold(changes).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def compact(self) -> None:
        """Fold what is written into a new base. Until it is whole the old one counts; batches and bases before it then go."""
        batches, before = self._batches(), self._folded()
        if not batches or batches[-1] <= before:
            return
        self._states().write.mode("overwrite").parquet(f"{self.path}/base/upto={batches[-1]}")
        for k in batches:
            _delete(self.spark, f"{self.path}/log/batch={k}")
        if before >= 0:
            _delete(self.spark, f"{self.path}/base/upto={before}")

    def read(self) -> DataFrame:
        """The live rows: keys, columns, and ``_last``, the order of the last upsert."""
        live = self._states().where("_gone IS NULL OR _last > _gone").where("_last IS NOT NULL")
        return live.select(*self.keys, *[F.when(F.col("_gone").isNull() | (F.col(f"{c}.at") > F.col("_gone")), F.col(f"{c}.value")).alias(c) for c in self.columns], "_last")


class PartitionedTable:
    """A Parquet table whose partitions are replaced whole, so that writing one again changes nothing, and dropped by name."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path, by

    def write(self, rows: DataFrame) -> None:
        """Replace the partitions that rows has; the others stay. A partition is written by as many tasks as hold its rows."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)

    def partitions(self) -> list[str]:
        return folders(self.spark, self.path, self.by)

    def drop_before(self, first: str) -> list[str]:
        """Delete the partitions named before ``first``; their names. Rows without a partition value stay."""
        old = [p for p in self.partitions() if p < first and not p.startswith("__HIVE")]
        for p in old:
            _delete(self.spark, f"{self.path}/{self.by}={p}")
        return old

    def read(self, schema: StructType) -> DataFrame:
        """The rows of the partitions that are there, also if there is none."""
        return self.spark.read.schema(schema).parquet(self.path) if self.partitions() else self.spark.createDataFrame([], schema)
