"""Keyed merges on immutable tables: latest row per key, upserts of some columns, insert-or-touch, expiry, running medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order per key, by a partial aggregate: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def keyed_merge(target: DataFrame, batch: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Upsert: rows of both sides take the batch's ``updated`` columns and keep the target's others; action tells what happened.

    Both sides have one row per key. A full outer join, so one shuffle of each side by the key.
    """
    rest = [c for c in target.columns if c not in keys]
    new = batch.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    value = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c not in updated)), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select(*keys, *map(value, rest), action.alias("action"))


def insert_or_touch(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of the batch with was_inserted: false where the target has them."""
    known = target.select(key).distinct().withColumn("_old", F.lit(True))
    return batch.select(key).distinct().join(known, key, "left").select(key, F.col("_old").isNull().alias("was_inserted"))


def expire(offers: DataFrame, fresh: DataFrame) -> DataFrame:
    """offers(product_id, buy_url, sell_url) with status: expired where neither listing is among fresh(url)."""
    seen = offers.select("product_id", F.explode(F.array("buy_url", "sell_url")).alias("url")).join(fresh.select("url"), "url", "left_semi")
    alive = seen.select("product_id").distinct().withColumn("_alive", F.lit(True))
    return offers.join(alive, "product_id", "left").withColumn("status", F.when(F.col("_alive"), "active").otherwise("expired")).drop("_alive")


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, cnt and the upper-middle value: the one at place floor(n / 2), counted from 0, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    ranked = df.select(key, value).withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    return ranked.groupBy(key).agg(F.max("n").alias("cnt"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col(value))).alias("mid"))


def drift_median(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """state(key, cnt, mid) moved towards batch(key, cnt, mid) by the batch's share of all counts."""
    both = state.join(batch.select(key, F.col("cnt").alias("b_cnt"), F.col("mid").alias("b_mid")), key, "full_outer")
    old, new = F.coalesce("cnt", F.lit(0)), F.coalesce("b_cnt", F.lit(0))
    mid = F.when(old == 0, F.col("b_mid")).when(new == 0, F.col("mid")).otherwise(F.col("mid") + (F.col("b_mid") - F.col("mid")) * new / (old + new))
    return both.select(key, (old + new).alias("cnt"), mid.alias("mid"))
