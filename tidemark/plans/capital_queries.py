"""Customers as portfolios: finished orders are closed trades, the lines of open orders candidates, an order a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.capital import Limits, evaluate
from tidemark.plans.define import query, split
from tidemark.sources.tables import MARKETPLACE, load

#: Orders lie days apart, so a product waits a month and a marketplace two minutes, that is, within its batch.
LIMITS = Limits(product_cooldown_s=30 * 86400)

_PNL = "cast(floor((l_discount - l_tax) * l_extendedprice * 10 + 5e-1) AS bigint)"
_CANDIDATE = (
    "o_custkey AS portfolio, o_orderkey AS batch, o_orderkey * 10 + l_linenumber AS opportunity_id, l_partkey AS product_id, CASE l_returnflag WHEN 'A' THEN 'amazon_us' WHEN 'N' THEN 'ebay' ELSE 'aliexpress' END AS buy_mp,"
    f" {MARKETPLACE} AS sell_mp, p_type AS category, least(100e0, l_quantity * 2) AS score, l_tax * 1000 AS risk, 1 - l_discount * 5 AS confidence, cast(floor(l_extendedprice / l_quantity * 10 + 5e-1) AS bigint) AS required_cents, l_extendedprice * l_discount / 10 AS profit"
)

# The twin folds by recursion: a portfolio's open positions are a list that grows by a row where a step approves.
_SQL = f"""WITH RECURSIVE trades AS (SELECT o_custkey AS portfolio, o_orderkey AS id, epoch_us(o_orderdate) AS at_us, CAST(sum({_PNL}) AS BIGINT) AS pnl FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL),
candidates AS MATERIALIZED (SELECT {_CANDIDATE}, epoch_us(o_orderdate) AS at_us FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O'),
line AS (SELECT portfolio, at_us, 0 AS kind, id, pnl FROM trades UNION ALL SELECT DISTINCT portfolio, at_us, 1, batch, NULL FROM candidates),
sums AS (SELECT *, 500000 + coalesce(sum(pnl) OVER w, 0) AS total, count(pnl) OVER w AS n, -coalesce(sum(CASE WHEN pnl < 0 THEN pnl END) OVER d, 0) AS day_loss FROM line
 WINDOW w AS (PARTITION BY portfolio ORDER BY at_us, kind, id ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY portfolio, at_us // 86400000000 ORDER BY at_us, kind, id ROWS UNBOUNDED PRECEDING)),
book AS (SELECT *, greatest(500000, max(total) OVER w) AS peak, count(CASE WHEN pnl >= 0 THEN 1 END) OVER w AS wins, n - coalesce(max(CASE WHEN pnl >= 0 THEN n END) OVER w, 0) AS streak, max(CASE WHEN pnl < 0 THEN at_us END) OVER w AS last_loss FROM sums
 WINDOW w AS (PARTITION BY portfolio ORDER BY at_us, kind, id ROWS UNBOUNDED PRECEDING)),
told AS (SELECT portfolio, id AS batch, at_us, CAST(total AS BIGINT) AS total, CASE WHEN streak >= 3 THEN 0.5e0 ELSE 1e0 END AS factor,
 concat_ws('; ', CASE WHEN (peak - total) / CAST(peak AS DOUBLE) >= 0.15 THEN 'drawdown' END, CASE WHEN total > 0 AND day_loss >= total * 0.05e0 THEN 'daily_loss' END, CASE WHEN n >= 10 AND wins / CAST(n AS DOUBLE) < 0.5 THEN 'win_rate' END) AS stops,
 concat_ws('; ', CASE WHEN (peak - total) / CAST(peak AS DOUBLE) >= 0.2 THEN 'drawdown' END, CASE WHEN (peak - total) / CAST(peak AS DOUBLE) >= 0.15 THEN 'capital_stop_loss' END, CASE WHEN day_loss >= 50000 THEN 'daily_loss' END, CASE WHEN at_us < last_loss + 3600000000 THEN 'cooldown' END) AS risks FROM book WHERE kind = 1),
ranked AS (SELECT c.*, total, factor, stops, risks, row_number() OVER (PARTITION BY portfolio, batch ORDER BY floor(confidence * profit * greatest(0.01e0, 1 - risk / 100) * 10000 + 0.5e0) DESC, opportunity_id, product_id) AS place FROM candidates c JOIN told USING (portfolio, batch, at_us)),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY at_us, batch, place) AS step FROM ranked WHERE stops = '' AND place <= 5),
fold AS (SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(p BIGINT, b VARCHAR, s VARCHAR, g VARCHAR, cents BIGINT, t BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS opportunity_id, CAST(NULL AS BIGINT) AS place, CAST(0 AS BIGINT) AS cents, CAST('' AS VARCHAR) AS reason FROM steps
 UNION ALL
 SELECT portfolio, step, CASE WHEN reason = '' THEN list_append(held, {{'p': product_id, 'b': buy_mp, 's': sell_mp, 'g': category, 'cents': cents, 't': at_us}}) ELSE held END, opportunity_id, place, CASE WHEN reason = '' THEN cents ELSE 0 END, reason
 FROM (SELECT *, CASE WHEN open >= 10 THEN 'max_active_trades' WHEN len(list_filter(held, lambda x: x.p = product_id AND at_us < x.t + 2592000000000)) > 0 THEN 'product cooldown'
   WHEN list_contains(busy, buy_mp) THEN concat('marketplace cooldown: ', buy_mp) WHEN list_contains(busy, sell_mp) THEN concat('marketplace cooldown: ', sell_mp) WHEN risks <> '' THEN risks
   WHEN base <= 0 THEN 'sizing: zero base allocation' WHEN capped < needed AND needed <= free AND needed > total * 0.2e0 THEN 'sizing: above the cap of a trade' WHEN sized < 2000 THEN 'sizing: below the minimum'
   WHEN broken <> '' THEN concat('concentration: ', broken) WHEN cents > free THEN 'insufficient capital' ELSE '' END AS reason
  FROM (SELECT *, concat_ws(', ', CASE WHEN (of_product + cents) / CAST(greatest(total, 100) AS DOUBLE) > 0.25 THEN 'product_id' END, CASE WHEN (of_mp + cents) / CAST(greatest(total, 100) AS DOUBLE) > 0.45 THEN 'sell_mp' END, CASE WHEN (of_category + cents) / CAST(greatest(total, 100) AS DOUBLE) > 0.4 THEN 'category' END) AS broken
   FROM (SELECT *, CAST(floor(sized + 0.5e0) AS BIGINT) AS cents
    FROM (SELECT *, CASE WHEN capped < needed AND needed <= free THEN needed ELSE capped END AS sized
     FROM (SELECT *, least(base * (1 - greatest(0e0, least(1e0, risk / 100)) * 0.6e0) * factor, total * 0.2e0, greatest(0e0, total * 0.4e0 - of_category), free) AS capped
      FROM (SELECT *, total - used AS free, total * 0.2e0 * greatest(0e0, least(1e0, score / 100)) AS base, required_cents * CASE WHEN confidence >= 0.8 THEN 1e0 ELSE 0.5e0 + confidence / 0.8e0 * 0.5e0 END AS needed
       FROM (SELECT *, len(held) AS open, coalesce(CAST(list_sum(list_transform(held, lambda x: x.cents)) AS BIGINT), 0) AS used, coalesce(CAST(list_sum(list_transform(list_filter(held, lambda x: x.p = product_id), lambda x: x.cents)) AS BIGINT), 0) AS of_product,
         coalesce(CAST(list_sum(list_transform(list_filter(held, lambda x: x.s = sell_mp), lambda x: x.cents)) AS BIGINT), 0) AS of_mp, coalesce(CAST(list_sum(list_transform(list_filter(held, lambda x: x.g = category), lambda x: x.cents)) AS BIGINT), 0) AS of_category,
         flatten(list_transform(list_filter(held, lambda x: at_us < x.t + 120000000), lambda x: [x.b, x.s])) AS busy
        FROM (SELECT s.*, list_filter(f.held, lambda x: s.at_us < x.t + 7776000000000) AS held FROM fold f JOIN steps s ON s.portfolio = f.portfolio AND s.step = f.step + 1)))))))))
SELECT portfolio, opportunity_id, CAST(place AS INTEGER) AS place, reason = '' AS approved, cents, reason FROM fold WHERE step > 0
UNION ALL SELECT portfolio, opportunity_id, CASE WHEN stops = '' THEN CAST(place AS INTEGER) END, FALSE, 0, CASE WHEN stops <> '' THEN concat('halted: ', stops) ELSE concat('ranked ', CAST(place AS VARCHAR), ' > top_k=5') END FROM ranked WHERE stops <> '' OR place > 5"""


def trades_and_candidates(spark, sf_dir):
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    orders = orders.withColumn("at_us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    lined = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    trades = lined.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("portfolio"), F.col("o_orderkey").alias("trade"), "at_us").agg(F.sum(F.expr(_PNL)).alias("pnl_cents"))
    sellers = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    open_ = lined.where("o_orderstatus = 'O'").join(load(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return trades, open_.selectExpr(*split(_CANDIDATE), "at_us")


@query("q_capital_evaluation", _SQL)
def q_capital_evaluation(spark, sf_dir):
    """Every candidate of every portfolio, in order of time: halted, ranked out, refused for what is open by then, or approved with its cents."""
    return evaluate(*trades_and_candidates(spark, sf_dir), LIMITS)
