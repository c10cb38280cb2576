"""Queries of keyed merges, serving reads, checks and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.operators import merge, ranks, scan
from tidemark.plans.define import query, split
from tidemark.plans.scan_queries import opps
from tidemark.plans.scan_sql import upto
from tidemark.sources.tables import AS_OF, listings, load, price_history

_r = fx.rounded
#: Lines before this day stand for the stored table, later ones for the new batch.
CUT = "2000-01-01"
_STATE = "concat(cast(l_partkey AS {text}), '-', cast(l_suppkey AS {text})) AS url, l_orderkey AS first_order, l_extendedprice / l_quantity AS usd, l_returnflag AS condition, l_shipdate AS scraped_at, l_orderkey, l_linenumber"


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, sf_dir, "lineitem").selectExpr(*split(_STATE.format(text="string")))
    latest = lambda df: merge.latest_by_key(df, ["url"], ["scraped_at", "l_orderkey", "l_linenumber"]).drop("l_orderkey", "l_linenumber")
    return latest(lines.where(f"scraped_at < timestamp_ntz '{CUT}'")), latest(lines.where(f"scraped_at >= timestamp_ntz '{CUT}'"))


_GEN_SQL = f"""lines AS (SELECT {_STATE.format(text="VARCHAR")} FROM lineitem),
old AS (SELECT * FROM lines WHERE scraped_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1),
new AS (SELECT * FROM lines WHERE scraped_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1)"""


@query("q_listing_upsert", f"""WITH {_GEN_SQL} SELECT coalesce(o.url, n.url) AS url, coalesce(o.first_order, n.first_order) AS first_order, {_r('coalesce(n.usd, o.usd)', 4)} AS usd,
 coalesce(n.condition, o.condition) AS condition, coalesce(n.scraped_at, o.scraped_at) AS scraped_at, CASE WHEN o.url IS NULL THEN 'inserted' WHEN n.url IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON o.url = n.url""")
def q_listing_upsert(spark, sf_dir):
    """Stored listings merged with a batch: prices and states are updated, the first order is kept."""
    old, new = _generations(spark, sf_dir)
    return merge.keyed_merge(old, new, ["url"], ["usd", "condition", "scraped_at"]).withColumn("usd", F.expr(_r("usd", 4)))


@query("q_key_semi_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 5)")
def q_key_semi_scan(spark, sf_dir):
    wanted = load(spark, sf_dir, "part").where("p_size <= 5").select("p_partkey")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("q_insert_or_touch", "WITH k AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0) SELECT DISTINCT p.p_name, k.p_name IS NULL AS was_inserted FROM part p LEFT JOIN k ON k.p_name = p.p_name")
def q_insert_or_touch(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return merge.insert_or_touch(parts.where("p_partkey % 2 = 0"), parts, "p_name")


@query("q_median_merge", f"""WITH p AS (SELECT l_partkey AS product_id, l_extendedprice / l_quantity AS usd, l_shipdate < TIMESTAMP '{CUT}' AS old FROM lineitem),
m AS (SELECT product_id, old, count(*) AS cnt, list_sort(list(usd))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mid FROM p GROUP BY ALL),
j AS (SELECT coalesce(o.product_id, n.product_id) AS product_id, o.cnt AS oc, o.mid AS om, n.cnt AS nc, n.mid AS nm FROM (FROM m WHERE old) o FULL JOIN (FROM m WHERE NOT old) n ON o.product_id = n.product_id)
SELECT product_id, coalesce(oc, 0) + coalesce(nc, 0) AS cnt, {_r("CASE WHEN oc IS NULL THEN nm WHEN nc IS NULL THEN om ELSE om + (nm - om) * nc / (oc + nc) END", 4)} AS mid FROM j""")
def q_median_merge(spark, sf_dir):
    """The running median that drifts towards each batch's upper median."""
    prices = price_history(spark, sf_dir).select("product_id", F.col("price_usd").alias("usd"), "recorded_at")
    old = merge.upper_median(prices.where(f"recorded_at < timestamp_ntz '{CUT}'"), "product_id", "usd")
    new = merge.upper_median(prices.where(f"recorded_at >= timestamp_ntz '{CUT}'"), "product_id", "usd")
    return merge.drift_median(old, new, "product_id").withColumn("mid", F.expr(_r("mid", 4)))


@query("q_median_exact", upto("listings", f"SELECT product_id, count(*) AS cnt, {_r('median(usd)', 4)} AS mid FROM listings GROUP BY product_id"))
def q_median_exact(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("cnt"), F.median("usd").alias("mid")).withColumn("mid", F.expr(_r("mid", 4)))


@query("q_expire_anti", upto("listings", """, offers AS (SELECT product_id, arg_min(url, (usd, url)) AS buy_url, arg_max(url, (usd, url)) AS sell_url FROM listings GROUP BY product_id),
fresh AS (SELECT url FROM listings WHERE scraped_at > TIMESTAMP '2001-11-05' - INTERVAL 200 DAYS)
SELECT product_id, buy_url, sell_url, CASE WHEN EXISTS (SELECT 1 FROM fresh f WHERE f.url IN (o.buy_url, o.sell_url)) THEN 'active' ELSE 'expired' END AS status FROM offers o"""))
def q_expire_anti(spark, sf_dir):
    """Offers expire when neither their buy nor their sell listing is fresh."""
    rows = listings(spark, sf_dir)
    offers = rows.groupBy("product_id").agg(F.min_by("url", F.struct("usd", "url")).alias("buy_url"), F.max_by("url", F.struct("usd", "url")).alias("sell_url"))
    return merge.expire(offers, scan.fresh(rows, 200))


@query("q_opportunity_merge", f"""WITH l AS (SELECT l_partkey AS product_id, l_suppkey % 5 AS mp, l_extendedprice / l_quantity AS usd, l_shipdate < TIMESTAMP '{CUT}' AS old, l_orderkey FROM lineitem),
g AS (SELECT old, product_id, arg_min(mp, (usd, mp)) AS buy_mp, arg_max(mp, (usd, mp)) AS sell_mp, min(l_orderkey) AS id, max(usd) - min(usd) AS profit FROM l GROUP BY old, product_id)
SELECT coalesce(o.product_id, n.product_id) AS product_id, coalesce(o.buy_mp, n.buy_mp) AS buy_mp, coalesce(o.sell_mp, n.sell_mp) AS sell_mp, coalesce(o.id, n.id) AS id, {_r("coalesce(n.profit, o.profit)", 2)} AS profit,
 CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM (FROM g WHERE old) o FULL JOIN (FROM g WHERE NOT old) n ON o.product_id = n.product_id AND o.buy_mp = n.buy_mp AND o.sell_mp = n.sell_mp""")
def q_opportunity_merge(spark, sf_dir):
    """A second scan refreshes active opportunities by (product, buy, sell); ids stay."""
    lines = load(spark, sf_dir, "lineitem").selectExpr("l_partkey AS product_id", "l_suppkey % 5 AS mp", "l_extendedprice / l_quantity AS usd", "l_shipdate", "l_orderkey")
    by = F.struct("usd", "mp")
    found = lambda df: df.groupBy("product_id").agg(F.min_by("mp", by).alias("buy_mp"), F.max_by("mp", by).alias("sell_mp"), F.min("l_orderkey").alias("id"), (F.max("usd") - F.min("usd")).alias("profit"))
    old, new = found(lines.where(f"l_shipdate < timestamp_ntz '{CUT}'")), found(lines.where(f"l_shipdate >= timestamp_ntz '{CUT}'"))
    return merge.keyed_merge(old, new, ["product_id", "buy_mp", "sell_mp"], ["profit"]).withColumn("profit", F.expr(_r("profit", 2)))


@query("q_retention", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, strftime(l_shipdate, '%Y-%m') < '2001-05' AS dropped FROM lineitem GROUP BY 1")
def q_retention(spark, sf_dir):
    """Monthly partitions older than six months are to be dropped."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    return load(spark, sf_dir, "lineitem").groupBy(month.alias("month")).agg(F.count("*").alias("n")).withColumn("dropped", F.col("month") < F.date_format(F.add_months(F.lit(AS_OF).cast("date"), -6), "yyyy-MM"))


_BACKFILL = f"o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS level, {_r('greatest(0.0, least(100.0, o_totalprice / 4000))', 1)} AS score"


@query("q_backfill_scores", f"SELECT {_BACKFILL} FROM orders")
def q_backfill_scores(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr(*split(_BACKFILL))


@query("q_dq_checks", f"""SELECT 'orphans' AS test, (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)) AS n
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'references', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))
UNION ALL SELECT 'sanity', (SELECT count(*) FROM lineitem WHERE l_extendedprice / l_quantity NOT BETWEEN 0.5 AND 50000)
UNION ALL SELECT 'identity', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1 OR l_tax < 0)""")
def q_dq_checks(spark, sf_dir):
    """Rows that break each of five rules: orphans, repeated keys, dangling references, implausible prices, bad rates."""
    line, part, orders, customer = (load(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    failing = {
        "orphans": line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
        "duplicates": line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "references": orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "sanity": line.where("l_extendedprice / l_quantity NOT BETWEEN 0.5 AND 50000"),
        "identity": line.where("l_discount < 0 OR l_discount > 1 OR l_tax < 0"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("test"), "n") for name, df in failing.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("q_list_opportunities", upto("opps", f"SELECT opps.product_id, p_name, buy_mp, sell_mp, net_profit, roi, opportunity_score, b.condition AS buy_condition, s.condition AS sell_condition FROM opps JOIN part ON p_partkey = opps.product_id LEFT JOIN listings b ON b.url = buy_url LEFT JOIN listings s ON s.url = sell_url WHERE roi >= 0.3 AND buy_usd <= 5000 AND (buy_mp = 'amazon_us' OR sell_mp = 'mercadolibre_cl') ORDER BY opportunity_score DESC, opps.product_id LIMIT 50 OFFSET 5"))
def q_list_opportunities(spark, sf_dir):
    """A page of opportunities under optional filters, with both listings; a top-k report."""
    rows = listings(spark, sf_dir).select("url", "condition")
    side = lambda name: rows.select(F.col("url").alias(f"{name}_url"), F.col("condition").alias(f"{name}_condition"))
    found = opps(spark, sf_dir).where("roi >= 0.3 AND buy_usd <= 5000 AND (buy_mp = 'amazon_us' OR sell_mp = 'mercadolibre_cl')")
    top = found.select("product_id", "buy_mp", "sell_mp", "net_profit", "roi", "opportunity_score", "buy_url", "sell_url").orderBy(F.desc("opportunity_score"), "product_id").offset(5).limit(50)
    named = top.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_name"), "product_id")
    return named.join(side("buy"), "buy_url", "left").join(side("sell"), "sell_url", "left").drop("buy_url", "sell_url")


@query("q_dashboard_stats", upto("opps", f"SELECT count(*) AS n, coalesce({_r('avg(roi)', 3)}, 0) AS avg_roi, coalesce({_r('avg(net_profit)', 1)}, 0) AS avg_profit, coalesce(max(roi), 0) AS best_roi, (SELECT sell_mp FROM opps GROUP BY sell_mp ORDER BY count(*) DESC, sell_mp DESC LIMIT 1) AS top_mp FROM opps"))
def q_dashboard_stats(spark, sf_dir):
    found = opps(spark, sf_dir)
    by_mp = found.groupBy("sell_mp").agg(F.count("*").alias("n"), F.sum("roi").alias("roi"), F.sum("net_profit").alias("profit"), F.max("roi").alias("best"))
    out = by_mp.agg(F.sum("n").alias("n"), (F.sum("roi") / F.sum("n")).alias("avg_roi"), (F.sum("profit") / F.sum("n")).alias("avg_profit"), F.coalesce(F.max("best"), F.lit(0.0)).alias("best_roi"), F.max_by("sell_mp", F.struct("n", "sell_mp")).alias("top_mp"))
    return out.withColumns({"avg_roi": F.expr(f"coalesce({_r('avg_roi', 3)}, 0)"), "avg_profit": F.expr(f"coalesce({_r('avg_profit', 1)}, 0)")})


@query("q_marketplace_union", upto("opps", "SELECT buy_mp AS mp FROM opps UNION SELECT sell_mp FROM opps"))
def q_marketplace_union(spark, sf_dir):
    return opps(spark, sf_dir).select(F.explode(F.array("buy_mp", "sell_mp")).alias("mp")).distinct()


@query("q_related_listings", upto("listings", f"SELECT product_id, url, {_r('usd', 4)} AS usd, row_number() OVER (PARTITION BY product_id ORDER BY usd, url) AS place FROM listings"))
def q_related_listings(spark, sf_dir):
    """Listings of each product by price."""
    w = Window.partitionBy("product_id").orderBy("usd", "url")
    return listings(spark, sf_dir).select("product_id", "url", "usd", F.row_number().over(w).alias("place")).withColumn("usd", F.expr(_r("usd", 4)))


_BASE = "((least(100.0, avg_roi * 100)) * 0.30 + least(100.0, avg_profit / 2) * 0.20 + avg_velocity * 0.20 + (100 - avg_competition) * 0.15 + avg_demand * 0.15)"
_CATEGORY = f"category, n_products, {_r('avg_roi', 4)} AS avg_roi, {_r('avg_profit', 2)} AS avg_profit, best_roi, {_r(f'least(100.0, {_BASE} * CASE WHEN n_products >= 20 THEN 1.1 WHEN n_products >= 10 THEN 1.05 ELSE 1.0 END)', 1)} AS category_score"
_CATEGORY_AGG = {"n_products": "count(DISTINCT product_id)", "avg_roi": "avg(roi)", "avg_profit": "avg(net_profit)", "best_roi": "max(roi)", "avg_velocity": "avg(velocity)", "avg_competition": "avg(competition_score)", "avg_demand": "avg(f_demand)"}


@query("q_category_stats", upto("opps", f"SELECT {_CATEGORY} FROM (SELECT p_type AS category, {', '.join(f'{e} AS {n}' for n, e in _CATEGORY_AGG.items())} FROM opps JOIN part ON p_partkey = product_id GROUP BY p_type)"))
def q_category_stats(spark, sf_dir):
    """Rollup of opportunities by category, with a composite score."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    by = opps(spark, sf_dir).join(parts, "product_id").groupBy("category").agg(*[F.expr(e).alias(n) for n, e in _CATEGORY_AGG.items()])
    return by.selectExpr(*split(_CATEGORY))


#: Delivery channels as a small literal dimension: name, least score, ROI and profit, most risk.
CHANNELS = (("premium", 70.0, 0.30, 50.0, 40.0), ("standard", 50.0, 0.20, 20.0, 60.0), ("all", 0.0, 0.15, 20.0, 100.0))
_CHANNEL_VALUES = ", ".join(f"('{n}', {', '.join(f'CAST({x} AS double)' for x in rest)})" for n, *rest in CHANNELS)
_CHANNEL_MATCH = "opportunity_score >= min_score AND roi >= min_roi AND net_profit >= min_profit AND risk_score <= max_risk"


@query("q_channel_match", upto("opps", f"SELECT channel, product_id, opportunity_score FROM opps JOIN (VALUES {_CHANNEL_VALUES}) t(channel, min_score, min_roi, min_profit, max_risk) ON {_CHANNEL_MATCH}"))
def q_channel_match(spark, sf_dir):
    """Events fan out to the channels whose limits they meet: a range join with three literal rows."""
    channels = spark.sql(f"SELECT * FROM VALUES {_CHANNEL_VALUES} AS t(channel, min_score, min_roi, min_profit, max_risk)")
    found = opps(spark, sf_dir).select("product_id", "opportunity_score", "roi", "net_profit", "risk_score")
    return found.join(F.broadcast(channels), F.expr(_CHANNEL_MATCH)).select("channel", "product_id", "opportunity_score")


#: A customer's alert settings; without a cap any buy price will do.
_SETTINGS = "c_custkey AS user_id, greatest(0.15e0, floor(c_acctbal / 100) / 100.0e0) AS min_roi, (c_custkey % 40) * 25.0e0 AS min_profit, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE greatest(c_acctbal, 100.0e0) END AS max_buy"
_MET = "roi >= min_roi AND net_profit >= min_profit AND (max_buy IS NULL OR buy_usd <= max_buy)"
_ALERT_SQL = f", cfg AS (SELECT {_SETTINGS} FROM customer) SELECT user_id, product_id, roi FROM cfg JOIN opps ON {_MET}"
#: Width of a bucket of ROI, and the highest one that passes the scan's filters.
_STEP, _TOP = 0.05, 30
#: Shares of the customers for each core.
_SHARES = 4


@query("q_alert_match", upto("opps", _ALERT_SQL))
@query("q_alert_match_whole", upto("opps", _ALERT_SQL))
def q_alert_match(spark, sf_dir):
    """Opportunities that meet customers' alert settings on ROI, profit and buy price.

    ROI is bounded on both sides by the scan, so settings are copied to the buckets of ROI they admit, and an equi-join on
    the bucket replaces the range join; only rows whose ROI can match meet. A bucket is cut by customer into shares, each of
    which gets the bucket's opportunities: few buckets and small tables would leave all pairs to one or two tasks.
    """
    bucket = lambda c: F.floor(F.col(c) / _STEP).cast("int")
    shares = _SHARES * spark.sparkContext.defaultParallelism
    found = opps(spark, sf_dir).select("product_id", "roi", "net_profit", "buy_usd").withColumn("bucket", bucket("roi"))
    found = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    cfg = load(spark, sf_dir, "customer").selectExpr(*split(_SETTINGS)).withColumn("share", F.pmod(F.xxhash64("user_id"), F.lit(shares)).cast("int"))
    cfg = cfg.withColumn("bucket", F.explode(F.sequence(F.least(bucket("min_roi"), F.lit(_TOP)), F.lit(_TOP))))
    # A number of partitions that is asked for is kept, where adaptive execution would read small sides in one task.
    cfg, found = (df.repartition(shares, "bucket", "share") for df in (cfg, found))
    return cfg.join(found, ["bucket", "share"]).where(_MET).select("user_id", "product_id", "roi")


_OUTCOME = "l_partkey AS product_id, l_extendedprice * 0.1 AS est, l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice * 0.92 AS act, l_returnflag <> 'R' AS sold, l_linestatus = 'F' AS executed"
_PROFIT_ERR = "CASE WHEN est <> 0 THEN (act - est) / abs(est) * 100 WHEN act = 0 THEN 0.0 ELSE 100.0 END"
_PRECISION = f"count(*) AS n_executed, count(CASE WHEN act > 0 AND sold THEN 1 END) AS n_success, {_r('count(CASE WHEN act > 0 AND sold THEN 1 END) * 1.0 / count(*)', 4)} AS precision, {_r(f'avg({_PROFIT_ERR})', 2)} AS avg_error_pct, {_r('avg(act)', 2)} AS avg_actual, {_r('avg(est)', 2)} AS avg_expected"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*split(_OUTCOME))


@query("q_precision", f"SELECT {_PRECISION} FROM (SELECT {_OUTCOME} FROM lineitem) WHERE executed")
def q_precision(spark, sf_dir):
    """Predicted against actual profit of executed trades."""
    return outcomes(spark, sf_dir).where("executed").selectExpr(*split(_PRECISION))


#: Threshold name to (start, step when tightened, least, most).
ADAPTIVE = {"min_profit": (20.0, 2.0, 10.0, 50.0), "min_roi": (0.15, 0.05, 0.10, 0.40), "min_confidence": (85.0, 1.0, 70.0, 95.0), "min_reviews": (50.0, 10.0, 20.0, 200.0), "min_rating": (4.2, 0.1, 3.5, 4.8)}
_ADAPT = ", ".join(f"{_r(f'CASE WHEN n < 10 THEN {s} WHEN rate < 0.7 THEN least(CAST({hi} AS double), {s} + {d}) WHEN rate > 0.7 THEN greatest(CAST({lo} AS double), {s} - {d} / 2) ELSE {s} END', 4)} AS {n}" for n, (s, d, lo, hi) in ADAPTIVE.items())
_RATE = "count(*) AS n, count(CASE WHEN act > 0 AND sold THEN 1 END) * 1.0 / count(*) AS rate"


@query("q_adaptive_state", f"SELECT {_ADAPT} FROM (SELECT {_RATE} FROM (SELECT {_OUTCOME} FROM lineitem) WHERE executed)")
def q_adaptive_state(spark, sf_dir):
    """Thresholds tightened below the target precision, relaxed by half a step above it."""
    return outcomes(spark, sf_dir).where("executed").selectExpr(*split(_RATE)).selectExpr(*split(_ADAPT))


_TRADES = f"o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_won, CASE WHEN count(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 END) = 0 THEN 0.0 ELSE {_r("count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100.0 / greatest(1, count(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 END))", 1)} END AS win_rate"


@query("q_trade_accuracy", f"SELECT {_TRADES} FROM orders GROUP BY o_orderpriority")
def q_trade_accuracy(spark, sf_dir):
    cols = split(_TRADES)
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.expr(c) for c in cols[1:]])


_BOOK = f"count(*) AS n, count(DISTINCT o_custkey) AS n_customers, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_pending, {_r("sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END)", 2)} AS executing_cost, {_r("sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)", 2)} AS executed_cost"


@query("q_portfolio_summary", f"SELECT {_BOOK} FROM orders")
def q_portfolio_summary(spark, sf_dir):
    return load(spark, sf_dir, "orders").agg(*[F.expr(c) for c in split(_BOOK)])


_ORDERS = f"o_orderstatus, count(*) AS n, {_r('avg(o_totalprice)', 2)} AS avg_cost, max(o_orderdate) AS latest"


@query("q_orders_by_status", f"SELECT {_ORDERS} FROM orders GROUP BY o_orderstatus")
def q_orders_by_status(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.expr(c) for c in split(_ORDERS)[1:]])


_STAGE = "CASE o_orderstatus WHEN 'F' THEN 'executed' WHEN 'P' THEN 'executing' ELSE 'pending' END"


@query("q_order_transitions", f"""WITH s AS (SELECT o_custkey, o_orderkey, {_STAGE} AS state, lag({_STAGE}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)
SELECT o_custkey, o_orderkey, was, state, (was, state) IN (('pending', 'executing'), ('executing', 'executed')) AS valid FROM s WHERE was IS NOT NULL""")
def q_order_transitions(spark, sf_dir):
    """Each step of a customer's log against the valid transitions."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.expr(_STAGE).alias("state")).withColumn("was", F.lag("state").over(w)).where("was IS NOT NULL")
    valid = spark.sql("SELECT * FROM VALUES ('pending', 'executing', true), ('executing', 'executed', true) AS t(was, state, valid)")
    return log.join(F.broadcast(valid), ["was", "state"], "left").select("o_custkey", "o_orderkey", "was", "state", F.coalesce("valid", F.lit(False)).alias("valid"))


_HIST = ", ".join(f"max(CASE WHEN i = CAST(floor(n * {q}) AS BIGINT) THEN value END) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))


@query("q_histogram_index", f"SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS most, {_HIST} FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def q_histogram_index(spark, sf_dir):
    """Percentiles by index rule: the value at floor(n q), from counts by value, as few types hold all events."""
    return ranks.by_index(load(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


_PROM = "concat('events_total{type=\"', event_type, '\"} ', cast(count(*) AS {text}))"


@query("q_prometheus", f"SELECT {_PROM.replace('{text}', 'VARCHAR')} AS line FROM events GROUP BY event_type")
def q_prometheus(spark, sf_dir):
    """Counters as lines of the text exposition format."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.expr(_PROM.replace("{text}", "string")).alias("line")).select("line")


_RSS = "concat('<item><title>', replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</title><guid>opp-', cast(product_id AS {text}), '</guid><description>', buy_mp, ' to ', sell_mp, ', profit ', cast(cast(floor(net_profit) AS bigint) AS {text}), '</description></item>')"


@query("q_rss", upto("opps", f"SELECT product_id, {_RSS.format(text='VARCHAR')} AS item FROM opps JOIN part ON p_partkey = product_id ORDER BY opportunity_score DESC, product_id LIMIT 200"))
def q_rss(spark, sf_dir):
    """The 200 best opportunities as feed items."""
    top = opps(spark, sf_dir).select("product_id", "buy_mp", "sell_mp", "net_profit", "opportunity_score").orderBy(F.desc("opportunity_score"), "product_id").limit(200)
    named = top.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_name"), "product_id")
    return named.selectExpr("product_id", f"{_RSS.format(text='string')} AS item")


@query("q_freshness", "SELECT event_type, max(ts) AS latest, floor((epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 60) AS minutes, floor((epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 60) > 60 AS stale FROM events GROUP BY event_type")
def q_freshness(spark, sf_dir):
    by = load(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("latest"))
    minutes = F.floor((F.unix_timestamp(F.lit("2024-02-01").cast("timestamp_ntz")) - F.unix_micros(F.col("latest").cast("timestamp")) / 1e6) / 60)
    return by.withColumn("minutes", minutes.cast("double")).withColumn("stale", F.col("minutes") > 60)


@query("q_json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"event_id\":', event_id, ',\"k\":', CAST(json_extract(props, '$.k') AS BIGINT), '}') AS payload FROM events")
def q_json_roundtrip(spark, sf_dir):
    """Decode props, encode a payload."""
    rows = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.withColumn("payload", F.to_json(F.struct("event_id", "k")))


_DISCOVERY = "count(*) AS n_products, count(CASE WHEN n_mp >= 2 THEN 1 END) AS multi_market, count(CASE WHEN latest > {day} THEN 1 END) AS fresh, count(CASE WHEN n_listings >= 10 THEN 1 END) AS deep"


@query("q_discovery_stats", upto("listings", "SELECT " + _DISCOVERY.format(day="TIMESTAMP '2001-10-01'") + " FROM (SELECT product_id, count(DISTINCT mp) AS n_mp, count(*) AS n_listings, max(scraped_at) AS latest FROM listings GROUP BY product_id)"))
def q_discovery_stats(spark, sf_dir):
    by = listings(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("mp").alias("n_mp"), F.count("*").alias("n_listings"), F.max("scraped_at").alias("latest"))
    return by.selectExpr(*split(_DISCOVERY.format(day="timestamp_ntz '2001-10-01'")))

