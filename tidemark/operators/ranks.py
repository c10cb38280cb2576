"""Exact order statistics whose keys may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written


def running_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n (equal rows), upto (rows of the key up to this value) and total (rows of the key).

    Equal values are counted before the shuffle. The counts are spread by ranges of (key, value) and written once, with the
    range each one is in; what comes before a range is a sum over one row per key and range, and inside a range it is a
    window. So a key of any size is as many tasks as it has ranges, and a value that repeats is one row. Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()), "counts")
    of_key = Window.partitionBy(key)
    before = F.sum("m").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    ranges = placed.groupBy(key, "_range").agg(F.sum("n").alias("m")).withColumns({"_before": before, "total": F.sum("m").over(of_key)})
    found = placed.join(ranges.withColumnRenamed(key, "_key").withColumnRenamed("_range", "_r"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    inside = F.sum("n").over(Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("upto", F.col("_before") + inside).select(key, value, "n", "upto", "total")


def by_index(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key, n, least, most, and for each name the value at place floor(n * share), counted from 0, in order."""
    run = running_counts(rows, key, value)
    at = lambda q: F.floor(F.col("total") * F.lit(q))
    picked = [F.max(F.when((at(q) < F.col("upto")) & (at(q) >= F.col("upto") - F.col("n")), F.col(value))).alias(name) for name, q in shares.items()]
    return run.groupBy(key).agg(F.max("total").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *picked)
