"""Queries over time: snapshots, trends, forecasts, lifecycles, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.operators import series
from tidemark.plans.define import query, split
from tidemark.sources.tables import AS_OF, load, price_history

_r = fx.rounded

SNAP = """snap AS (SELECT l_partkey AS product_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS listing_count, count(DISTINCT l_suppkey) AS seller_count, count(DISTINCT n_regionkey) AS marketplace_count,
 avg(l_extendedprice / l_quantity) AS avg_price, min(l_extendedprice / l_quantity) AS min_price, max(l_extendedprice / l_quantity) AS max_price, sum(l_quantity) AS total_sales, CAST(sum(l_orderkey % 120) AS BIGINT) AS total_reviews
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"""
_SNAP = f"product_id, month, listing_count, seller_count, marketplace_count, {_r('avg_price', 4)} AS avg_price, {_r('min_price', 4)} AS min_price, {_r('max_price', 4)} AS max_price, total_sales, total_reviews"


@query("q_snapshot_monthly", f"WITH {SNAP} SELECT {_SNAP} FROM snap")
def q_snapshot_monthly(spark, sf_dir):
    return series.monthly_snapshots(spark, sf_dir).selectExpr(*split(_SNAP))


def _asof(days: int) -> str:
    return f"(SELECT * FROM snap WHERE month <= DATE '{AS_OF}' - {days} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY month DESC) = 1)"


VELO = f"""{SNAP}, velo AS (SELECT c.*, s.listing_count AS past_short, l.listing_count AS past_long, f.first_month > DATE '{AS_OF}' - 90 AS is_new FROM {_asof(0)} c LEFT JOIN {_asof(30)} s USING (product_id) LEFT JOIN {_asof(90)} l USING (product_id)
 JOIN (SELECT product_id, min(month) AS first_month FROM snap GROUP BY product_id) f USING (product_id))"""
_V7, _V30 = fx.VELOCITY_RATE.format(now="listing_count", past="past_short"), fx.VELOCITY_RATE.format(now="listing_count", past="past_long")
_VELO = f"product_id, month, listing_count, past_short, past_long, {_r(_V7, 4)} AS velocity_7d, {_r(_V30, 4)} AS velocity_30d"


@query("q_snapshot_asof_velocity", f"WITH {VELO} SELECT {_VELO} FROM velo")
def q_snapshot_asof_velocity(spark, sf_dir):
    return series.velocities(series.monthly_snapshots(spark, sf_dir)).selectExpr(*split(_VELO))


#: Score, label and whether a product trends, from the velocity of its listings.
_TREND = f"product_id, {fx.TREND_SCORE} AS trend_score, {fx.TREND_LABEL} AS trend_label, {fx.TREND_SCORE} >= 60 AS is_trending"


_DEMAND = f"{_TREND}, is_new, listing_count"
DEMAND_SQL = f"WITH {VELO} SELECT {_DEMAND} FROM (SELECT *, {_V7} AS velocity_7d FROM velo)"


def demand_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of each product with a snapshot: score, label, whether it trends or is new, and its listings."""
    found = series.velocities(series.monthly_snapshots(spark, sf_dir)).withColumn("velocity_7d", F.expr(_V7))
    return found.selectExpr(*split(_DEMAND))


@query("q_trend_score_label", f"SELECT product_id, trend_score, trend_label, is_trending FROM ({DEMAND_SQL})")
def q_trend_score_label(spark, sf_dir):
    return demand_trends(spark, sf_dir).select("product_id", "trend_score", "trend_label", "is_trending")


@query("q_snapshot_series", f"""WITH s AS (SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price FROM lineitem),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY product_id, day ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)
SELECT product_id, day, {_r('price', 4)} AS price FROM d QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY day) <= 30""")
def q_snapshot_series(spark, sf_dir):
    """The last price of each day, of the oldest 30 days of each product."""
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_partkey AS product_id", "cast(l_shipdate AS date) AS day", "l_orderkey", "l_linenumber", "l_extendedprice / l_quantity AS price")
    daily = rows.groupBy("product_id", "day").agg(F.max_by("price", F.struct("l_orderkey", "l_linenumber")).alias("price"))
    oldest = daily.withColumn("rn", F.row_number().over(Window.partitionBy("product_id").orderBy("day"))).where("rn <= 30")
    return oldest.selectExpr("product_id", "day", f"{_r('price', 4)} AS price")


MOMENTUM = """mom AS (SELECT product_id, count(*) AS n, avg(CASE WHEN rn <= 3 THEN ret END) AS recent, avg(ret) AS overall, max(CASE WHEN rn = 1 THEN change END) AS acceleration
 FROM (SELECT *, ret - lag(ret) OVER (PARTITION BY product_id ORDER BY month) AS change, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS rn
 FROM (SELECT *, (avg_price - before) / before AS ret FROM (SELECT *, lag(avg_price) OVER (PARTITION BY product_id ORDER BY month) AS before FROM snap))) GROUP BY product_id)"""
_MOM = "(0.7 * recent + 0.3 * overall)"
_MOM_SCORE = f"(least(50.0, abs{_MOM} * 500) + least(50.0, abs(coalesce(acceleration, 0.0)) * 1000))"
_MOM_DIR = f"CASE WHEN n < 3 THEN 'stable' WHEN {_MOM} > 0.02 THEN 'rising' WHEN {_MOM} < -0.02 THEN 'falling' ELSE 'stable' END"
_MOMENTUM = f"product_id, n, {_r('recent', 5)} AS recent_return, {_r('acceleration', 5)} AS acceleration, {_r(_MOM, 5)} AS momentum, {_MOM_DIR} AS direction, CASE WHEN n < 3 THEN 0.0 ELSE {_r(_MOM_SCORE, 1)} END AS score"


@query("q_momentum", f"WITH {SNAP}, {MOMENTUM} SELECT {_MOMENTUM} FROM mom")
def q_momentum(spark, sf_dir):
    return series.momentum(series.monthly_snapshots(spark, sf_dir)).selectExpr(*split(_MOMENTUM))


VOLUME = """vol AS (SELECT *, (recent - older) / older AS volume_change FROM (SELECT product_id, max(n) AS n, avg(CASE WHEN rn <= 3 THEN listing_count END) AS recent, avg(CASE WHEN n - rn < greatest(n - 3, 1) THEN listing_count END) AS older
 FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY product_id) AS n FROM snap) GROUP BY product_id))"""
_RATIO = "(CASE WHEN velocity_30d > 0 THEN velocity_7d / velocity_30d ELSE velocity_7d END)"
_VEL_SCORE = f"least(100.0, greatest(0.0, ({_RATIO} - 1) * 40 + volume_change * 20 + 30))"
_VEL_DIR = f"CASE WHEN {_RATIO} > 1.5 THEN 'rising' WHEN {_RATIO} < 0.5 THEN 'falling' ELSE 'stable' END"
_VEL_STRENGTH = f"CASE WHEN {_RATIO} > 3 OR abs(volume_change) > 1 THEN 'strong' WHEN {_RATIO} > 1.8 OR abs(volume_change) > 0.5 THEN 'moderate' ELSE 'weak' END"
_VEL = f"product_id, {_r(_RATIO, 3)} AS velocity_ratio, {_r('volume_change', 3)} AS volume_change, {_VEL_DIR} AS direction, {_VEL_STRENGTH} AS strength, {_r(_VEL_SCORE, 1)} AS score"
_RATES = f"SELECT velo.product_id, {_r(_V7, 4)} AS velocity_7d, {_r(_V30, 4)} AS velocity_30d, volume_change"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = series.trends(series.monthly_snapshots(spark, sf_dir))
    return rates.withColumns({"velocity_7d": F.expr(_r(_V7, 4)), "velocity_30d": F.expr(_r(_V30, 4))})


@query("q_trend_velocity", f"WITH {VELO}, {VOLUME} SELECT {_VEL} FROM ({_RATES} FROM velo JOIN vol USING (product_id))")
def q_trend_velocity(spark, sf_dir):
    return _rates(spark, sf_dir).selectExpr(*split(_VEL))


_BOTH = f"product_id, {_r('score1 * 0.5 + score2 * 0.5', 1)} AS trend_score, dir1 AS direction, score1 * 0.5 + score2 * 0.5 >= 70 AND ratio > 2.5 AS is_breakout"


TREND_SQL = f"""WITH {VELO}, {VOLUME}, {MOMENTUM} SELECT {_BOTH} FROM (SELECT v.product_id, {_RATIO} AS ratio, {_r(_VEL_SCORE, 1)} AS score1, {_VEL_DIR} AS dir1, CASE WHEN mom.n < 3 THEN 0.0 ELSE {_r(_MOM_SCORE, 1)} END AS score2, {_MOM_DIR} AS dir2
 FROM ({_RATES} FROM velo JOIN vol USING (product_id)) v JOIN mom USING (product_id))"""


def product_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both strategies at equal weight; on a split vote the first one's direction stands. One row per product with a snapshot."""
    both = _rates(spark, sf_dir).selectExpr("product_id", f"{_RATIO} AS ratio", f"{_r(_VEL_SCORE, 1)} AS score1", f"{_VEL_DIR} AS dir1", f"CASE WHEN n < 3 THEN 0.0 ELSE {_r(_MOM_SCORE, 1)} END AS score2")
    return both.selectExpr(*split(_BOTH))


@query("q_trend_aggregate", TREND_SQL)
def q_trend_aggregate(spark, sf_dir):
    return product_trends(spark, sf_dir)


_FORECAST = f"product_id, n, status, CASE WHEN n >= 30 THEN 'prophet' WHEN n >= 14 THEN 'xgboost' ELSE 'baseline' END AS preferred, coalesce({_r('predicted', 2)}, 0.0e0) AS predicted, {_r('greatest(0.01, predicted - width)', 2)} AS low, {_r('predicted + width', 2)} AS high, {_r('mape', 2)} AS mape, coalesce({_r('least(0.9, greatest(0.1, 0.3 * least(n / 30.0, 1.0) + 0.7 * greatest(0.0, 1 - mape / 50)))', 3)} * CASE WHEN status = 'ok' THEN 1 ELSE 0 END, 0.0e0) AS confidence"


def _forecast_sql(key: str) -> str:
    return f"""WITH p AS (SELECT {key} AS product_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_extendedprice / l_quantity AS price FROM lineitem),
s AS (SELECT product_id, min(day) AS day0, max(day) AS day1, count(*) AS n FROM p GROUP BY product_id), x AS (SELECT p.*, s.n, day1 - day0 AS reach, CAST(day - day0 AS DOUBLE) AS x FROM p JOIN s USING (product_id)),
f AS (SELECT product_id, CASE WHEN max(x) > 0 THEN regr_slope(price, x) ELSE 0.0 END AS slope, avg(price) AS mean_price, avg(x) AS mean_x FROM x GROUP BY product_id), g AS (SELECT product_id, slope, mean_price - slope * mean_x AS intercept FROM f),
e AS (SELECT x.*, slope, intercept, price - (slope * x + intercept) AS residual FROM x JOIN g USING (product_id)),
o AS (SELECT product_id, max(n) AS n, CASE WHEN max(n) >= 3 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN max(n) >= 3 THEN greatest(0.01, max(slope) * (max(reach) + 7) + max(intercept)) END AS predicted, CASE WHEN max(n) >= 3 THEN stddev_pop(residual) * 1.96 END AS width, CASE WHEN max(n) >= 3 THEN avg(abs(residual / price)) * 100 END AS mape FROM e GROUP BY product_id) SELECT {_FORECAST} FROM o"""


FORECAST_SQL = _forecast_sql("l_partkey")


def week_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline forecast a week ahead; longer series prefer models that are not installed, whose fallback this is."""
    prices = price_history(spark, sf_dir).select("product_id", F.unix_date(F.col("recorded_at").cast("date")).alias("day"), F.col("price_usd").alias("price"))
    return series.linear_forecast(prices).selectExpr(*split(_FORECAST))


@query("q_forecast_ols", FORECAST_SQL)
def q_forecast_ols(spark, sf_dir):
    return week_forecasts(spark, sf_dir)


@query("q_forecast_sellers", _forecast_sql("l_suppkey * 100000 + l_partkey"))
def q_forecast_sellers(spark, sf_dir):
    """The same per seller and product: series of one to some prices, of which those below three get a failed row."""
    prices = price_history(spark, sf_dir).select((F.col("seller_id") * 100000 + F.col("product_id")).alias("product_id"), F.unix_date(F.col("recorded_at").cast("date")).alias("day"), F.col("price_usd").alias("price"))
    return series.linear_forecast(prices).selectExpr(*split(_FORECAST))


_LAGS = "product_id, seq, weekday, " + ", ".join(f"{_r(f'lag_{k}', 4)} AS lag_{k}" for k in range(1, 8)) + f", {_r('mean', 4)} AS mean, {_r('dev', 3)} AS dev, {_r('slope', 3)} AS slope"


@query("q_lag_features", f"""WITH p AS (SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS recorded_at, l_extendedprice / l_quantity AS price, CAST(isodow(l_shipdate) - 1 AS BIGINT) AS weekday FROM lineitem),
n AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS i FROM p WINDOW w AS (PARTITION BY product_id ORDER BY recorded_at, seq)),
f AS (SELECT *, {", ".join(f"lag(price, {k}) OVER w AS lag_{k}" for k in range(1, 8))}, avg(price) OVER b AS mean, stddev_pop(price) OVER b AS dev, regr_slope(price, i) OVER b AS slope FROM n
 WINDOW w AS (PARTITION BY product_id ORDER BY recorded_at, seq), b AS (PARTITION BY product_id ORDER BY recorded_at, seq ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT {_LAGS} FROM f WHERE i > 7""")
def q_lag_features(spark, sf_dir):
    prices = price_history(spark, sf_dir).select("product_id", "seq", "recorded_at", F.col("recorded_at").alias("day"), F.col("price_usd").alias("price"))
    return series.lag_features(prices).selectExpr(*split(_LAGS))


def _slope_signal(slope: str, mean: str, n: str) -> str:
    return f"(CASE WHEN {n} < 2 THEN NULL WHEN {mean} = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, {slope} / abs({mean}) * {n} / 0.10)) END)"


_COMP = "CASE WHEN abs(comp_signal) > 1e-9 THEN {} ELSE 0.0 END"
_DECAY = f"(profit_signal * 0.6 - {_COMP.format('comp_signal * 0.15')}) / (0.6 + {_COMP.format('0.15')})"
_LIFE1 = f"o_custkey, n, hours, CASE WHEN n < 2 THEN 0.0 ELSE {_r(f'greatest(-1.0, least(1.0, {_DECAY}))', 4)} END AS decay"
_DECAY_PART, _AGE_PART = "greatest(0.0, least(100.0, (1 - decay) * 50))", "CASE WHEN hours > 0 THEN least(95.0, 30 * log2(hours / 24 + 1)) ELSE 0.0 END"
_URGENCY = f"CASE WHEN n < 2 THEN 50.0 WHEN n / 5.0 > 0.5 THEN {_r(f'({_DECAY_PART}) * 0.65 + ({_AGE_PART}) * 0.35', 1)} ELSE {_r(f'({_DECAY_PART}) * 0.3 + ({_AGE_PART}) * 0.4 + 50 * (1 - n / 5.0) * 0.3', 1)} END"
_LIFE = f"o_custkey, n, hours, decay, {_URGENCY} AS urgency, CASE WHEN n <= 2 OR hours < 12 THEN 'fresh' WHEN decay <= -0.15 THEN 'decaying' ELSE 'stable' END AS label"


def lifecycle_sql(source: str) -> str:
    """The lifecycle of each series of a relation (o_custkey, o_orderdate, o_orderkey, profit, comp)."""
    return f"""WITH l AS (SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS i FROM l),
s AS (SELECT o_custkey, count(*) AS n, (epoch(TIMESTAMP '2002-01-01') - epoch(min(o_orderdate))) / 3600.0 AS hours, {_slope_signal('regr_slope(profit, i)', 'avg(profit)', 'count(*)')} AS profit_signal, {_slope_signal('regr_slope(comp, i)', 'avg(comp)', 'count(*)')} AS comp_signal FROM i GROUP BY o_custkey)
SELECT {_LIFE} FROM (SELECT {_LIFE1} FROM s)"""


def lifecycles(rows: DataFrame) -> DataFrame:
    """The same of rows(o_custkey, o_orderdate, o_orderkey, profit, comp); the latest 100 of a key are kept before the shuffle."""
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("rn <= 100")
    by = last.withColumn("i", -F.col("rn").cast("double")).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.expr("(unix_timestamp(timestamp_ntz '2002-01-01') - unix_timestamp(min(o_orderdate))) / 3600.0").alias("hours"),
        F.expr(_slope_signal("regr_slope(profit, i)", "avg(profit)", "count(*)")).alias("profit_signal"), F.expr(_slope_signal("regr_slope(comp, i)", "avg(comp)", "count(*)")).alias("comp_signal"),
    )
    return by.selectExpr(*split(_LIFE1)).selectExpr(*split(_LIFE))


_SERIES = "o_custkey, o_orderdate, o_orderkey, o_totalprice AS profit, CAST(o_orderkey % 7 AS DOUBLE) AS comp"


@query("q_lifecycle", lifecycle_sql(f"SELECT {_SERIES} FROM orders"))
def q_lifecycle(spark, sf_dir):
    """Decay, urgency and label of each series from its latest 100 snapshots; absent signals leave the weighting."""
    return lifecycles(load(spark, sf_dir, "orders").selectExpr(*split(_SERIES)))


_GAIN = "o_custkey, o_orderdate, o_orderkey, floor(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.05 ELSE -o_totalprice * 0.06 END) AS gain"


@query("q_drawdown", f"""WITH g AS (SELECT {_GAIN} FROM orders), t AS (SELECT *, 50000 + sum(gain) OVER w AS total FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(50000.0, max(total) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM t)
SELECT o_custkey, count(*) AS n, arg_max(total, (o_orderdate, o_orderkey)) AS total, max(peak) AS peak, {_r('max((peak - total) / peak)', 4)} AS max_drawdown FROM p GROUP BY o_custkey""")
def q_drawdown(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr(*split(_GAIN)).withColumn("gain", F.col("gain").cast("double"))
    run = series.ledger(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "gain", 50000.0)
    by = run.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("total", F.struct("o_orderdate", "o_orderkey")).alias("total"), F.max("peak").alias("peak"), F.max("drawdown").alias("d"))
    return by.selectExpr("o_custkey", "n", "total", "peak", f"{_r('d', 4)} AS max_drawdown")


@query("q_loss_streak", f"""WITH g AS (SELECT {_GAIN} FROM orders), i AS (SELECT *, sum(CASE WHEN gain >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT *, sum(CASE WHEN gain < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, island ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT o_custkey, CAST(max(streak) AS BIGINT) AS worst, CAST(arg_max(streak, (o_orderdate, o_orderkey)) AS BIGINT) AS now FROM s GROUP BY o_custkey""")
def q_loss_streak(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr(*split(_GAIN)).withColumn("gain", F.col("gain").cast("double"))
    run = series.ledger(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "gain", 50000.0)
    return run.groupBy("o_custkey").agg(F.max("streak").alias("worst"), F.max_by("streak", F.struct("o_orderdate", "o_orderkey")).alias("now"))


_EMA = "least({p} * 1.05, greatest({p} * 0.95, {p} * 0.7 + {v} * 0.3))"


@query("q_ema_capped", f"""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value > 0),
r AS (SELECT user_id, i, CAST(value AS DOUBLE) AS ema FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, {_EMA.format(p='r.ema', v='e.value')} FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, max(i) AS n, {_r('arg_max(ema, i)', 4)} AS ema FROM r GROUP BY user_id""")
def q_ema_capped(spark, sf_dir):
    """A moving average whose step is capped at a twentieth, per user: a fold in Arrow batches over rows in order.

    Rows are range-sorted within the user's partition and read as a stream, so a user of many rows is never held whole.
    """
    rows = load(spark, sf_dir, "events").where("value > 0").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "value")

    def fold(batches):
        import pyarrow as pa

        user, n, ema, started = None, 0, 0.0, False
        for batch in batches:
            done = []
            for u, v in zip(batch["user_id"].to_pylist(), batch["value"].to_pylist()):
                if not started or u != user:
                    if started:
                        done.append((user, n, ema))
                    user, n, ema, started = u, 1, v, True
                else:
                    n, ema = n + 1, min(ema * 1.05, max(ema * 0.95, ema * 0.7 + v * 0.3))
            yield pa.RecordBatch.from_pydict({"user_id": pa.array([x[0] for x in done], pa.int64()), "n": pa.array([x[1] for x in done], pa.int64()), "ema": pa.array([x[2] for x in done], pa.float64())})
        if started:
            yield pa.RecordBatch.from_pydict({"user_id": pa.array([user], pa.int64()), "n": pa.array([n], pa.int64()), "ema": pa.array([ema], pa.float64())})

    return ordered.mapInArrow(fold, "user_id long, n long, ema double").withColumn("ema", F.expr(_r("ema", 4)))
