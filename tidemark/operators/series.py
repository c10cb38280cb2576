"""Time series of products: monthly snapshots, as-of joins, velocities, momentum, forecasts, lag features, running ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import AS_OF, load


def monthly_snapshots(spark: SparkSession, sf_dir: str, seen: str = "true") -> DataFrame:
    """One row per product and month of the lines that meet ``seen``: listings, sellers, marketplaces, prices, sales, reviews."""
    line = load(spark, sf_dir, "lineitem").where(seen).selectExpr("l_partkey AS product_id", "l_suppkey", "cast(date_trunc('month', l_shipdate) AS date) AS month", "l_extendedprice / l_quantity AS price", "l_quantity", "l_orderkey % 120 AS reviews")
    sellers = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    return line.join(sellers, "l_suppkey").groupBy("product_id", "month").agg(
        F.count("*").alias("listing_count"), F.countDistinct("l_suppkey").alias("seller_count"), F.countDistinct("n_regionkey").alias("marketplace_count"),
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum("l_quantity").alias("total_sales"), F.sum("reviews").alias("total_reviews"),
    )


def _velocity_of(columns: list[str], short: int, long: int) -> dict:
    """Aggregates of a product's snapshots: the current one, listing counts of two moments before, and whether it is new."""
    day = F.lit(AS_OF).cast("date")
    upto = lambda days, value: F.max_by(F.when(F.col("month") <= F.date_sub(day, days), value), F.when(F.col("month") <= F.date_sub(day, days), F.col("month")))
    rest = F.struct(*[c for c in columns if c != "product_id"])
    return {"now": upto(0, rest), "past_short": upto(short, F.col("listing_count")), "past_long": upto(long, F.col("listing_count")), "is_new": F.min("month") > F.date_sub(day, long)}


def velocities(snapshots: DataFrame, short: int = 30, long: int = 90) -> DataFrame:
    """Each product's current snapshot with listing counts of two moments before, and whether it is new: one aggregate."""
    of = _velocity_of(snapshots.columns, short, long)
    by = snapshots.groupBy("product_id").agg(*[e.alias(n) for n, e in of.items()])
    return by.where("now IS NOT NULL").select("product_id", "now.*", "past_short", "past_long", "is_new")


def stepped(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ret (return since the one before), change (of the return), rn (1: the latest) and n of their product."""
    w = Window.partitionBy("product_id")
    steps = snapshots.withColumn("before", F.lag("avg_price").over(w.orderBy("month"))).withColumn("ret", (F.col("avg_price") - F.col("before")) / F.col("before"))
    counted = steps.withColumn("n", F.count("*").over(w)).withColumn("rn", F.col("n") - F.row_number().over(w.orderBy("month")) + 1)
    return counted.withColumn("change", F.col("ret") - F.lag("ret").over(w.orderBy("month")))


def _last_three(column: str):
    return F.avg(F.when(F.col("rn") <= 3, F.col(column)))


def _older():
    """Mean listing count before the latest three snapshots, of the first one at least."""
    return F.avg(F.when(F.col("n") - F.col("rn") < F.greatest(F.col("n") - 3, F.lit(1)), F.col("listing_count")))


def momentum(snapshots: DataFrame) -> DataFrame:
    """Mean of the latest three returns and of all, and the last change of the return."""
    return stepped(snapshots).groupBy("product_id").agg(F.max("n").alias("n"), _last_three("ret").alias("recent"), F.avg("ret").alias("overall"), F.max(F.when(F.col("rn") == 1, F.col("change"))).alias("acceleration"))


def volume_change(snapshots: DataFrame) -> DataFrame:
    """Mean listing count of the latest three snapshots against that of all before (the first one at least)."""
    by = stepped(snapshots).groupBy("product_id").agg(F.max("n").alias("n"), _last_three("listing_count").alias("recent"), _older().alias("older"))
    return by.withColumn("volume_change", (F.col("recent") - F.col("older")) / F.col("older"))


def trends(snapshots: DataFrame, short: int = 30, long: int = 90) -> DataFrame:
    """velocities, momentum and volume change of each product in one aggregate, whose windows share its partitioning."""
    told = {"n": F.max("n"), "recent": _last_three("ret"), "overall": F.avg("ret"), "acceleration": F.max(F.when(F.col("rn") == 1, F.col("change"))), "volume": _last_three("listing_count"), "older": _older()}
    of = _velocity_of(["product_id", "listing_count"], short, long) | told
    by = stepped(snapshots.select("product_id", "month", "listing_count", "avg_price")).groupBy("product_id").agg(*[e.alias(n) for n, e in of.items()]).where("now IS NOT NULL")
    return by.select("product_id", "now.listing_count", "past_short", "past_long", "is_new", "n", "recent", "overall", "acceleration", ((F.col("volume") - F.col("older")) / F.col("older")).alias("volume_change"))


def linear_forecast(prices: DataFrame, horizon: int = 7, least: int = 3) -> DataFrame:
    """Least-squares line per product over days since its first price, with residual spread and error; two grouped aggregates.

    prices(product_id, day, price); products of fewer than ``least`` rows get a failed row without a forecast.
    """
    start = prices.groupBy("product_id").agg(F.min("day").alias("day0"), F.max("day").alias("day1"), F.count("*").alias("n"))
    x = prices.join(start, "product_id").withColumn("x", (F.col("day") - F.col("day0")).cast("double"))
    fit = x.groupBy("product_id").agg(F.regr_slope("price", "x").alias("slope"), F.avg("price").alias("mean_price"), F.avg("x").alias("mean_x"))
    # Prices of a single day have no slope: the line is their mean.
    fit = fit.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("intercept", F.col("mean_price") - F.col("slope") * F.col("mean_x"))
    fitted = x.join(fit, "product_id").withColumn("residual", F.col("price") - (F.col("slope") * F.col("x") + F.col("intercept")))
    last = F.max(F.col("day1") - F.col("day0")) + horizon
    out = fitted.groupBy("product_id").agg(F.max("n").alias("n"), F.max("slope").alias("slope"), F.greatest(F.lit(0.01), F.max("slope") * last + F.max("intercept")).alias("predicted"), F.stddev_pop("residual").alias("dev"), (F.avg(F.abs(F.col("residual") / F.col("price"))) * 100).alias("mape"))
    out = out.withColumn("width", 1.96 * F.col("dev") * F.sqrt(F.lit(horizon / 7.0)))
    told = F.col("n") >= least
    return out.withColumns({c: F.when(told, F.col(c)) for c in ("slope", "predicted", "dev", "mape", "width")}).withColumn("status", F.when(told, F.lit("ok")).otherwise(F.lit("failed")))


def lag_features(prices: DataFrame, lags: int = 7) -> DataFrame:
    """Lags 1 to ``lags``, rolling mean, spread and slope of the rows before, weekday; rows without enough history go."""
    w = Window.partitionBy("product_id").orderBy("day", "seq")
    before = w.rowsBetween(-lags, -1)
    number = F.row_number().over(w).cast("double")
    out = prices.withColumn("i", number)
    out = out.withColumns({f"lag_{k}": F.lag("price", k).over(w) for k in range(1, lags + 1)})
    out = out.withColumns({"mean": F.avg("price").over(before), "dev": F.stddev_pop("price").over(before), "slope": F.regr_slope("price", "i").over(before), "weekday": F.weekday("recorded_at")})
    return out.where(F.col("i") > lags)


def ledger(rows: DataFrame, key: str, order: list[str], gain: str, start: float) -> DataFrame:
    """Running total, high-water mark, drawdown and streak of losses along each key; all of them windows."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("total", F.sum(gain).over(upto) + start)
    out = out.withColumn("peak", F.greatest(F.lit(start), F.max("total").over(upto))).withColumn("drawdown", (F.col("peak") - F.col("total")) / F.col("peak"))
    # A win starts an island; losses since then are the streak.
    out = out.withColumn("island", F.count_if(F.col(gain) >= 0).over(upto))
    inside = Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("streak", F.count_if(F.col(gain) < 0).over(inside)).drop("island")
