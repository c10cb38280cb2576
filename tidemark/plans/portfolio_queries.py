"""Queries about capital in use: selection under limits, cooldowns after trades, and the positions that are kept."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.operators.cooldown import last_within
from tidemark.plans.decision_queries import _RANK
from tidemark.plans.define import query, split
from tidemark.plans.scan_queries import pairs
from tidemark.plans.scan_sql import upto
from tidemark.sources.tables import load

# Limits of one selection.
CAPITAL, MOST_OPEN, MOST_RISK, PER_PRODUCT, PER_ROUTE, BATCH = 5000.0, 20, 70.0, 3, 5, 500
_DENSITY = fx.rounded(f"({_RANK}) / greatest(buy_usd, 0.01)", 8)
_CANDIDATE = f"product_id, concat(buy_mp, '>', sell_mp) AS route, buy_usd, risk_score, {_DENSITY} AS density"

_KNAPSACK_SQL = f""", c AS MATERIALIZED (SELECT {_CANDIDATE} FROM scored ORDER BY density DESC, product_id, route LIMIT {BATCH}),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY density DESC, product_id, route) AS place FROM c),
f AS (SELECT CAST(0 AS BIGINT) AS place, CAST({CAPITAL} AS DOUBLE) AS available, CAST([] AS BIGINT[]) AS products, CAST([] AS VARCHAR[]) AS routes, CAST(NULL AS VARCHAR) AS verdict
UNION ALL SELECT place, CASE WHEN verdict = 'approved' THEN available - buy_usd ELSE available END, CASE WHEN verdict = 'approved' THEN list_append(products, product_id) ELSE products END, CASE WHEN verdict = 'approved' THEN list_append(routes, route) ELSE routes END, verdict
 FROM (SELECT r.*, available, products, routes, CASE WHEN r.buy_usd > available THEN 'capital' WHEN r.risk_score > {MOST_RISK} THEN 'risk' WHEN len(products) >= {MOST_OPEN} THEN 'positions'
  WHEN len(list_filter(products, lambda x: x = r.product_id)) >= {PER_PRODUCT} THEN 'product' WHEN len(list_filter(routes, lambda x: x = r.route)) >= {PER_ROUTE} THEN 'route' ELSE 'approved' END AS verdict FROM f JOIN r ON r.place = f.place + 1))
SELECT r.place, product_id, route, density, verdict FROM f JOIN r USING (place)"""


@query("q_knapsack", upto("scored", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _KNAPSACK_SQL)
def q_knapsack(spark, sf_dir):
    """Greedy selection from the batch of 500 densest pairs, under limits of capital, risk, positions, products and routes.

    Each choice depends on all before it, so it is a fold over one batch, as the batch window of the optimizer is.
    """
    return selected(pairs(spark, sf_dir).selectExpr(*split(_CANDIDATE)).orderBy(F.desc("density"), "product_id", "route").limit(BATCH))


def selected(top):
    """The verdict on each candidate of one bounded batch, in order of density: approved, or the first limit it meets."""
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("density")).alias("order"), "product_id", "route", "buy_usd", "risk_score"))).alias("c"))
    start = F.struct(F.lit(CAPITAL).alias("available"), F.lit(0).alias("open"), F.array().cast("array<struct<density:double,product_id:bigint,route:string,verdict:string>>").alias("judged"))
    return listed.select(F.aggregate("c", start, _judge, lambda acc: acc["judged"]).alias("x")).select(F.posexplode("x").alias("i", "y")).select((F.col("i") + 1).cast("long").alias("place"), "y.*")


def _judge(acc, x):
    held = lambda column: F.size(F.filter(acc["judged"], lambda y: (y["verdict"] == "approved") & (y[column] == x[column])))
    verdict = (
        F.when(x["buy_usd"] > acc["available"], "capital").when(x["risk_score"] > MOST_RISK, "risk").when(acc["open"] >= MOST_OPEN, "positions")
        .when(held("product_id") >= PER_PRODUCT, "product").when(held("route") >= PER_ROUTE, "route").otherwise("approved")
    )
    bought = verdict == "approved"
    one = F.struct((-x["order"]).alias("density"), x["product_id"].alias("product_id"), x["route"].alias("route"), verdict.alias("verdict"))
    return F.struct(F.when(bought, acc["available"] - x["buy_usd"]).otherwise(acc["available"]).alias("available"), (acc["open"] + bought.cast("int")).alias("open"), F.array_append(acc["judged"], one).alias("judged"))


# Returned lines stand for candidates, the others for committed trades; the seconds of a day come from the order's number.
PRODUCT_COOLDOWN, MARKET_COOLDOWN = 30 * 86400, 6 * 3600
_AT = "{day} + l_orderkey * 7919 % 86400 AS sec"
_TRADE = "l_orderkey, l_linenumber, l_partkey AS product, l_suppkey % 40 AS buy_mp, l_suppkey % 7 + 40 AS sell_mp"
_DAY = {"spark": "unix_date(cast(l_shipdate AS date)) * 86400L", "duckdb": "CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT)"}



_COOLDOWN = "l_orderkey, l_linenumber, product, buy_mp, sell_mp, sec, " + (
    f"CASE WHEN of_product IS NOT NULL THEN 'product' WHEN of_buy IS NOT NULL THEN 'buy' WHEN of_sell IS NOT NULL THEN 'sell' ELSE 'none' END AS cooldown, coalesce(of_product + {PRODUCT_COOLDOWN}, of_buy + {MARKET_COOLDOWN}, of_sell + {MARKET_COOLDOWN}) - sec AS remaining"
)


@query("q_cooldowns", f"""WITH t AS MATERIALIZED (SELECT {_TRADE}, {_AT.format(day=_DAY['duckdb'])}, l_returnflag = 'R' AS asks FROM lineitem), c AS MATERIALIZED (SELECT * FROM t WHERE asks),
p AS MATERIALIZED (SELECT DISTINCT product AS key, sec FROM t WHERE NOT asks), m AS MATERIALIZED (SELECT DISTINCT unnest([buy_mp, sell_mp]) AS key, sec FROM t WHERE NOT asks),
a AS (SELECT c.*, p.sec AS of_product FROM c ASOF LEFT JOIN p ON c.product = p.key AND c.sec >= p.sec), b AS (SELECT a.*, m.sec AS of_buy FROM a ASOF LEFT JOIN m ON a.buy_mp = m.key AND a.sec >= m.sec), d AS (SELECT b.*, m.sec AS of_sell FROM b ASOF LEFT JOIN m ON b.sell_mp = m.key AND b.sec >= m.sec)
SELECT {_COOLDOWN} FROM (SELECT * REPLACE (CASE WHEN of_product + {PRODUCT_COOLDOWN} > sec THEN of_product END AS of_product, CASE WHEN of_buy + {MARKET_COOLDOWN} > sec THEN of_buy END AS of_buy, CASE WHEN of_sell + {MARKET_COOLDOWN} > sec THEN of_sell END AS of_sell) FROM d)""")
def q_cooldowns(spark, sf_dir):
    """Which candidates wait after a trade of their product, or on one of their two marketplaces, and how long."""
    trades = load(spark, sf_dir, "lineitem").selectExpr(*split(_TRADE), _AT.format(day=_DAY["spark"]), "l_returnflag = 'R' AS asks")
    made = trades.where("not asks")
    on_market = made.select(F.explode(F.array("buy_mp", "sell_mp")).alias("mp"), "sec")
    out = last_within(trades.where("asks").drop("asks"), made, "product", "sec", PRODUCT_COOLDOWN, "of_product")
    for side in ("buy", "sell"):
        out = last_within(out, on_market.withColumnRenamed("mp", f"{side}_mp"), f"{side}_mp", "sec", MARKET_COOLDOWN, f"of_{side}")
    return out.selectExpr(*split(_COOLDOWN))


# Orders stand for positions on record, the first line of each for what the portfolio holds now.
_RECORD = "o_orderkey AS opportunity_id, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS status, o_totalprice AS entry_price"
_SAVED = "l_orderkey AS opportunity_id, CASE l_returnflag WHEN 'N' THEN 'open' WHEN 'A' THEN 'closed' ELSE 'failed' END AS status, l_extendedprice AS price, l_extendedprice * l_discount AS profit, l_linenumber, l_partkey, l_suppkey"


@query("q_portfolio_save", f"""WITH p AS (SELECT {_RECORD} FROM orders WHERE o_orderpriority <> '5-LOW'), s AS (SELECT * FROM (SELECT {_SAVED} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY l_linenumber, l_partkey, l_suppkey, price, profit, status) = 1)
SELECT p.opportunity_id, CASE WHEN s.status IS NULL THEN p.status ELSE s.status END AS status, entry_price, s.price AS exit_price, s.profit AS actual_profit FROM p LEFT JOIN s ON s.opportunity_id = p.opportunity_id AND p.status = 'open' AND s.status <> 'open'
UNION ALL SELECT opportunity_id, 'open', price, NULL, NULL FROM s WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM p WHERE p.opportunity_id = s.opportunity_id AND p.status = 'open')""")
def q_portfolio_save(spark, sf_dir):
    """Positions after saving a portfolio: ended ones close what is open, open ones are added where none is open; the rest stays.

    One shuffle by opportunity: rows on record and saved ones meet in a cogrouping by window instead of two joins.
    """
    record = load(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").selectExpr(*split(_RECORD))
    saved = load(spark, sf_dir, "lineitem").selectExpr(*split(_SAVED)).groupBy("opportunity_id").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "price", "profit", "status")).alias("new"))
    both = record.select("opportunity_id", F.struct("status", "entry_price").alias("old"), F.lit(None).cast(saved.schema["new"].dataType).alias("new")).unionByName(saved.withColumn("old", F.lit(None).cast("struct<status:string,entry_price:double>")), allowMissingColumns=True)
    w = Window.partitionBy("opportunity_id")
    met = both.withColumns({"is_open": F.coalesce(F.max(F.col("old.status") == "open").over(w), F.lit(False)), "saved": F.max("new").over(w)})
    ends = (F.col("old.status") == "open") & (F.col("saved.status") != "open")
    kept = met.where("old IS NOT NULL OR (new.status = 'open' AND NOT is_open)")
    return kept.select(
        "opportunity_id",
        F.when(F.col("old").isNull(), F.lit("open")).when(ends, F.col("saved.status")).otherwise(F.col("old.status")).alias("status"),
        F.coalesce("old.entry_price", "new.price").alias("entry_price"), F.when(ends, F.col("saved.price")).alias("exit_price"), F.when(ends, F.col("saved.profit")).alias("actual_profit"),
    )
