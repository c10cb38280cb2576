"""Queries of the scan: candidates, statistics, pairs, fees, scores, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.operators import scan
from tidemark.plans.define import query, split
from tidemark.plans.scan_sql import upto
from tidemark.sources.shared import written
from tidemark.sources.tables import dimension, listings, price_history


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.clean_listings(listings(spark, sf_dir))


def clean_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean listings with their facts, written once: the scan reads them three times, the lines once."""
    return written(scan.with_variants(scan.clean_listings(listings(spark, sf_dir, facts=True))), "clean")


def opps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.opportunities(spark, clean_once(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.opportunity_pairs(spark, clean_once(spark, sf_dir))


_r = fx.rounded
_LISTING = f"url, product_id, mp, condition, rating, reviews, sales, free_ship, scraped_at, currency, {_r('price', 2)} AS price, {_r('usd', 4)} AS usd"


def _listing_view(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[x.strip() for x in ("url, product_id, mp, condition, rating, reviews, sales, free_ship, scraped_at, currency").split(",")], f"{_r('price', 2)} AS price", f"{_r('usd', 4)} AS usd")


@query("q_listing_latest", upto("listings", f"SELECT {_LISTING} FROM listings"))
def q_listing_latest(spark, sf_dir):
    return _listing_view(listings(spark, sf_dir))


@query("q_fresh_scan", upto("listings", f"SELECT {_LISTING} FROM listings WHERE scraped_at > TIMESTAMP '2001-11-05' - INTERVAL 400 DAYS"))
def q_fresh_scan(spark, sf_dir):
    return _listing_view(scan.fresh(listings(spark, sf_dir), 400))


@query("q_trust_filter", upto("trusted", f"SELECT {_LISTING} FROM trusted"))
def q_trust_filter(spark, sf_dir):
    return _listing_view(scan.trusted(listings(spark, sf_dir)))


@query("q_price_bounds", upto("listings", f"SELECT {_LISTING} FROM listings JOIN price_bounds USING (currency) WHERE price BETWEEN least AND most"))
def q_price_bounds(spark, sf_dir):
    return _listing_view(scan.plausible(listings(spark, sf_dir), dimension(spark, "price_bounds")))


@query("q_iqr_outliers", upto("kept", f"SELECT {_LISTING} FROM kept"))
def q_iqr_outliers(spark, sf_dir):
    return _listing_view(scan.without_outliers(scan.trusted(listings(spark, sf_dir))))


@query("q_candidates_multi_mp", upto("kept", "SELECT product_id, count(DISTINCT mp) AS n_mp, count(*) AS n_listings FROM kept GROUP BY product_id HAVING count(DISTINCT mp) >= 2"))
def q_candidates_multi_mp(spark, sf_dir):
    return scan.in_several_markets(scan.without_outliers(scan.trusted(listings(spark, sf_dir))))


@query("q_fx_convert", upto("listings", f"SELECT l.url, f.currency, {_r('l.usd * f.rate', 2)} AS amount, CASE WHEN abs(f.rate * 1.6 - f.rate) / f.rate > 0.5 THEN f.rate ELSE f.rate * 1.6 END AS guarded_rate FROM listings l CROSS JOIN fx f WHERE f.currency IN ('EUR', 'BRL', 'COP')"))
def q_fx_convert(spark, sf_dir):
    """Prices in three more currencies; a live rate more than half off its reference is replaced by it. Three literal rates join every row."""
    rates = dimension(spark, "fx").where(F.col("currency").isin("EUR", "BRL", "COP")).withColumnRenamed("currency", "other").withColumnRenamed("rate", "other_rate")
    out = listings(spark, sf_dir).select("url", "usd").crossJoin(F.broadcast(rates))
    return out.selectExpr("url", "other AS currency", f"{_r('usd * other_rate', 2)} AS amount", "CASE WHEN abs(other_rate * 1.6 - other_rate) / other_rate > 0.5 THEN other_rate ELSE other_rate * 1.6 END AS guarded_rate")


_STATS = f"product_id, mp, n, {_r('min_usd', 4)} AS min_usd, {_r('avg_usd', 4)} AS avg_usd, {_r('price_spread', 4)} AS price_spread, sales_sum, reviews_sum, velocity"


@query("q_mp_stats", upto("stats", f"SELECT {_STATS}, buy_url, condition FROM stats"))
def q_mp_stats(spark, sf_dir):
    return scan.marketplace_stats(clean(spark, sf_dir)).selectExpr(*split(_STATS), "buy.url AS buy_url", "buy.condition AS condition")


@query("q_first_seen_age", upto("ages", f"SELECT url, first_at, {_r('age_days', 4)} AS age_days FROM ages"))
def q_first_seen_age(spark, sf_dir):
    return scan.first_seen(price_history(spark, sf_dir)).selectExpr("url", "first_at", f"{_r('age_days', 4)} AS age_days")


@query("q_stability", upto("stable", f"SELECT url, n_prices, {_r('price_avg', 4)} AS price_avg, stability FROM stable"))
def q_stability(spark, sf_dir):
    return scan.stability(price_history(spark, sf_dir)).selectExpr("url", "n_prices", f"{_r('price_avg', 4)} AS price_avg", "stability")


@query("q_depth", upto("depth", "SELECT product_id, mp, daily_sales, monthly_sales, depth_score, scalability FROM depth"))
def q_depth(spark, sf_dir):
    return scan.market_depth(scan.clean_listings(listings(spark, sf_dir, facts=True))).select("product_id", "mp", "daily_sales", "monthly_sales", "depth_score", "scalability")


@query("q_route_pairs", upto("pairs", f"SELECT product_id, buy_mp, sell_mp, label, difficulty, buy_url, {_r('buy_usd', 4)} AS buy_usd, {_r('min_usd', 4)} AS min_usd FROM pairs"))
def q_route_pairs(spark, sf_dir):
    out = scan.route_pairs(scan.marketplace_stats(clean(spark, sf_dir)), dimension(spark, "routes"))
    return out.selectExpr("product_id", "buy_mp", "sell_mp", "label", "difficulty", "buy_url", f"{_r('buy_usd', 4)} AS buy_usd", f"{_r('min_usd', 4)} AS min_usd")


_COMP = f"product_id, buy_mp, sell_mp, n, {_r('lowest_usd', 4)} AS lowest_usd, {_r('mean_usd', 4)} AS mean_usd, {_r('median_usd', 4)} AS median_usd, competition_score, sell_usd, sell_url"


@query("q_competition", upto("comp", f"SELECT {_COMP} FROM comp"))
def q_competition(spark, sf_dir):
    rows = scan.with_variants(clean(spark, sf_dir))
    return scan.competition(scan.route_pairs(scan.marketplace_stats(rows), dimension(spark, "routes")), rows).selectExpr(*split(_COMP))


_FEES = ", ".join(f"{_r(c, 2)} AS {c}" for c in scan.FEE_COLUMNS)
_PROFIT = f"product_id, buy_mp, sell_mp, {_FEES}, fees, net_profit, roi, margin"


@query("q_profit", upto("costs", f"SELECT {_PROFIT} FROM costs"))
def q_profit(spark, sf_dir):
    rows = scan.with_variants(clean(spark, sf_dir))
    found = scan.route_pairs(scan.marketplace_stats(rows), dimension(spark, "routes"))
    return scan.with_fees(scan.competition(found, rows), spark).selectExpr(*split(_PROFIT))


_ADJ = "((least(sell_usd, lowest_usd) - buy_usd * 1.05 - fees) * 0.70)"
_CONSERVATIVE = f"product_id, buy_mp, sell_mp, {_r('buy_usd * 1.05', 2)} AS adjusted_buy, {_r('least(sell_usd, lowest_usd)', 2)} AS adjusted_sell, {_r(_ADJ, 2)} AS adjusted_profit, {_r(_ADJ + ' / (buy_usd * 1.05)', 4)} AS adjusted_roi, CASE WHEN {_ADJ} < 20 THEN 'profit' WHEN {_ADJ} / (buy_usd * 1.05) < 0.15 THEN 'roi' END AS rejected_by, {_r(_ADJ + ' * 0.5', 2)} AS expected_value"


@query("q_conservative_profit", upto("scored", f"SELECT {_CONSERVATIVE} FROM scored"))
def q_conservative_profit(spark, sf_dir):
    return pairs(spark, sf_dir).selectExpr(*split(_CONSERVATIVE))


@query("q_soft_penalty", upto("scored", "SELECT product_id, buy_mp, sell_mp, soft_penalty, confidence_penalty FROM scored"))
def q_soft_penalty(spark, sf_dir):
    return pairs(spark, sf_dir).select("product_id", "buy_mp", "sell_mp", "soft_penalty", "confidence_penalty")


_FACTORS = ", ".join(f"{_r(f, 4)} AS {f}" for f in fx.FACTORS)


@query("q_score_factors", upto("scored", f"SELECT product_id, buy_mp, sell_mp, {_FACTORS} FROM scored"))
def q_score_factors(spark, sf_dir):
    return pairs(spark, sf_dir).selectExpr("product_id", "buy_mp", "sell_mp", *split(_FACTORS))


@query("q_scores", upto("scored", "SELECT product_id, buy_mp, sell_mp, opportunity_score, risk_score, confidence_score FROM scored"))
def q_scores(spark, sf_dir):
    return pairs(spark, sf_dir).select("product_id", "buy_mp", "sell_mp", "opportunity_score", "risk_score", "confidence_score")


_PROFILED = " UNION ALL ".join(f"SELECT product_id, buy_mp, sell_mp, '{p}' AS profile, score, {fx.risk_class(limits, 'score')} AS risk_class FROM (SELECT *, {fx.opportunity_score(w)} AS score FROM scored)" for p, (w, limits) in fx.PROFILES.items())


@query("q_profiles_risk_class", upto("scored", _PROFILED))
def q_profiles_risk_class(spark, sf_dir):
    """Each pair under each of the four profiles; a stack of expressions over one scan."""
    rows = pairs(spark, sf_dir)
    struct = lambda p, w, limits: F.struct(F.lit(p).alias("profile"), F.col(f"s_{p}").alias("score"), F.expr(fx.risk_class(limits, f"s_{p}")).alias("risk_class"))
    rows = rows.withColumns({f"s_{p}": F.expr(fx.opportunity_score(w)) for p, (w, _) in fx.PROFILES.items()})
    return rows.select("product_id", "buy_mp", "sell_mp", F.inline(F.array(*[struct(p, w, limits) for p, (w, limits) in fx.PROFILES.items()])))


@query("q_legacy_score", upto("scored", f"SELECT product_id, buy_mp, sell_mp, {fx.LEGACY_SCORE} AS legacy_score, CASE WHEN {fx.LEGACY_SCORE} >= 75 THEN 'high' WHEN {fx.LEGACY_SCORE} >= 50 THEN 'medium' ELSE 'low' END AS level FROM scored"))
def q_legacy_score(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("legacy_score", F.expr(fx.LEGACY_SCORE)).selectExpr("product_id", "buy_mp", "sell_mp", "legacy_score", "CASE WHEN legacy_score >= 75 THEN 'high' WHEN legacy_score >= 50 THEN 'medium' ELSE 'low' END AS level")


OPP_VIEW = f"product_id, buy_mp, sell_mp, label AS route, buy_url, sell_url, {_r('buy_usd', 2)} AS buy_price, {_r('sell_usd', 2)} AS sell_price, fees, net_profit, roi, margin, n AS competitor_count, competition_score, stability, daily_sales, monthly_sales, depth_score, scalability, opportunity_score, risk_score, confidence_score, CASE WHEN confidence_score >= 60 THEN 'high' WHEN confidence_score >= 40 THEN 'medium' ELSE 'low' END AS confidence_level, {_r('buy_usd * greatest(1.0, monthly_sales)', 2)} AS capital_required, CASE WHEN buy_usd < 50 THEN 'low' WHEN buy_usd < 200 THEN 'medium' ELSE 'high' END AS capital_tier"


@query("q_flagship_scan", upto("opps", f"SELECT {OPP_VIEW} FROM opps"))
def q_flagship_scan(spark, sf_dir):
    """The whole scan: the best opportunity of each product, with its costs and scores."""
    return opps(spark, sf_dir).selectExpr(*split(OPP_VIEW))


@query("q_best_per_product", upto("opps", "SELECT product_id, buy_mp, sell_mp, opportunity_score FROM opps"))
def q_best_per_product(spark, sf_dir):
    return opps(spark, sf_dir).select("product_id", "buy_mp", "sell_mp", "opportunity_score")


_GATES = (
    ("confidence", "confidence_score >= 85"),
    ("profit", "net_profit >= 20"),
    ("roi", "roi >= 0.15"),
    ("seller_rating", "coalesce(least(coalesce(buy_rating, 5), coalesce(sell_rating, 5)) >= 4.2 AND (buy_rating IS NOT NULL OR sell_rating IS NOT NULL), FALSE)"),
    ("reviews", "buy_reviews + sell_reviews >= 50"),
    ("liquidity", "monthly_sales >= 5 OR buy_reviews + sell_reviews >= 100"),
    ("price_consistency", "price_spread <= 0.10"),
    ("time_validity", "age_days * 24 >= 4"),
)
_LIQUIDITY = _r("least(60.0, monthly_sales / 30 * 60) + least(40.0, (buy_reviews + sell_reviews) / 200.0 * 40)", 1)
_REASONS_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in _GATES) + ")"


@query("q_gate_filters", upto("opps", f"SELECT product_id, {_LIQUIDITY} AS liquidity_score, {_REASONS_SQL} AS reasons, {_REASONS_SQL} = '' AS is_valid FROM opps"))
def q_gate_filters(spark, sf_dir):
    """Eight gates, all evaluated, failures collected in order."""
    reasons = F.array_compact(F.array(*[F.when(~F.expr(e), F.lit(n)) for n, e in _GATES]))
    return opps(spark, sf_dir).select("product_id", F.expr(_LIQUIDITY).alias("liquidity_score"), F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("is_valid"))


_DECAYED = {"sell_usd": "sell_usd * (1 - 0.005 * 180 / 3600)"}
_SIM = _r("sell_usd * 0.99975 - buy_usd - (" + " + ".join(f"({e})".replace("sell_usd", "(sell_usd * 0.99975)") for e in scan.FEE_COLUMNS.values()) + ")", 2)
_CHECKS = (
    ("price_freshness", "age_s <= 300"),
    ("spread_stability", "n < 2 OR coalesce(cv, 0) <= 0.25"),
    ("depth", "nearby >= 2 AND sales_sum >= 3"),
    ("worst_case_profit", "worst_case > 0"),
    ("execution_simulation", "simulated > 0"),
)
_WORST = _r("p25 - buy_usd * 1.02 - fees * 1.05", 2)
_PASSED = " + ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END" for _, e in _CHECKS)
_EXEC = _r(f"least(1.0, greatest(0.0, confidence_score / 100 * 0.25 + liquidity_score / 100 * 0.20 + stability / 100 * 0.15 + (1 - risk_score / 100) * 0.15 + opportunity_score / 100 * 0.10 + ({_PASSED}) / {len(_CHECKS)}.0 * 0.15))", 4)
_VALID_SQL = f"""SELECT product_id, worst_case, simulated, {_EXEC} AS execution_confidence, concat_ws('; ', {', '.join(f"CASE WHEN NOT ({e}) THEN '{n}' END" for n, e in _CHECKS)}, CASE WHEN {_EXEC} < 0.30 THEN 'execution_confidence' END) AS failed
FROM (SELECT *, {_WORST} AS worst_case FROM (SELECT o.*, x.cv, x.nearby, x.p25, {_SIM} AS simulated, {_LIQUIDITY} AS liquidity_score, epoch(TIMESTAMP '2001-11-05') - epoch(least(buy_at, sell_at)) AS age_s
      FROM opps o JOIN (SELECT o.product_id, stddev_samp(l.usd) / avg(l.usd) AS cv, count(*) FILTER (l.usd <= o.sell_usd * 1.05) AS nearby,
                               list_sort(list(l.usd))[CASE WHEN count(*) >= 4 THEN greatest(0, CAST(floor(count(*) * 0.25) AS BIGINT) - 1) + 1 ELSE 1 END] AS p25
                        FROM opps o JOIN clean l ON l.product_id = o.product_id AND l.mp = o.sell_mp AND l.condition = o.condition GROUP BY o.product_id, o.sell_usd) x USING (product_id)))"""


@query("q_validator", upto("opps", _VALID_SQL))
def q_validator(spark, sf_dir):
    """Checks of each chosen pair against its compatible sell prices: age, spread, depth, worst case, simulated sale, confidence."""
    rows = clean_once(spark, sf_dir)
    best = scan.opportunities(spark, rows)
    sells = rows.select("product_id", F.col("mp").alias("sell_mp"), F.explode("fits").alias("buy_variant"), "usd")
    met = best.select("product_id", "sell_mp", "buy_variant", "sell_usd").join(sells, ["product_id", "sell_mp", "buy_variant"])
    met = met.withColumn("i", F.row_number().over(Window.partitionBy("product_id").orderBy("usd"))).withColumn("k", F.count("*").over(Window.partitionBy("product_id")))
    place = F.when(F.col("k") >= 4, F.greatest(F.lit(0), F.floor(F.col("k") * 0.25) - 1) + 1).otherwise(1)
    per = met.groupBy("product_id").agg((F.stddev_samp("usd") / F.avg("usd")).alias("cv"), F.count_if(F.col("usd") <= F.col("sell_usd") * 1.05).alias("nearby"), F.max(F.when(F.col("i") == place, F.col("usd"))).alias("p25"))
    out = best.join(per, "product_id").withColumns({"simulated": F.expr(_SIM), "liquidity_score": F.expr(_LIQUIDITY), "age_s": F.expr("unix_timestamp(timestamp_ntz '2001-11-05') - unix_timestamp(least(buy_at, sell_at))"), "worst_case": F.expr(_WORST)})
    out = out.withColumn("execution_confidence", F.expr(_EXEC))
    failed = F.array(*[F.when(~F.expr(e), F.lit(n)) for n, e in _CHECKS], F.when(F.col("execution_confidence") < 0.30, F.lit("execution_confidence")))
    return out.select("product_id", "worst_case", "simulated", "execution_confidence", F.array_join(F.array_compact(failed), "; ").alias("failed"))


@query("q_history_collect", upto("history", f"SELECT url, string_agg(CAST(CAST(floor(price_usd * 100 + 0.500001) AS BIGINT) AS VARCHAR), ',' ORDER BY recorded_at DESC, seq DESC) AS prices FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY recorded_at DESC, seq DESC) AS rn FROM history) WHERE rn <= 20 GROUP BY url"))
def q_history_collect(spark, sf_dir):
    """The latest 20 prices of each url, newest first; the lists are bounded by the top-k filter."""
    w = Window.partitionBy("url").orderBy(F.col("recorded_at").desc(), F.col("seq").desc())
    top = price_history(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    cents = F.floor(F.col("price_usd") * 100 + 0.500001)
    listed = top.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("rn", cents.alias("c")))).alias("x"))
    return listed.select("url", F.array_join(F.transform("x", lambda s: s["c"].cast("string")), ",").alias("prices"))


_ANOMALY = "CASE WHEN price_usd <= 0.5 OR price_usd >= 50000 THEN 'bounds' WHEN k >= 3 AND mid > 0 AND (price_usd / mid > 5 OR price_usd / mid < 0.2) THEN 'ratio' ELSE 'ok' END AS verdict"
_ANOMALY_SQL = f"""SELECT url, seq, {_ANOMALY}
FROM (SELECT *, median(price_usd) OVER w AS mid, count(*) OVER w AS k FROM history WINDOW w AS (PARTITION BY product_id ORDER BY recorded_at, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("q_price_anomaly", upto("history", _ANOMALY_SQL))
def q_price_anomaly(spark, sf_dir):
    """Each price against bounds and the median of the product's 20 before it."""
    w = Window.partitionBy("product_id").orderBy("recorded_at", "seq").rowsBetween(-20, -1)
    before = F.array_sort(F.collect_list("price_usd").over(w))
    rows = price_history(spark, sf_dir).withColumn("before", before).withColumn("k", F.size("before"))
    mid = (F.get("before", ((F.col("k") - 1) / 2).cast("int")) + F.get("before", (F.col("k") / 2).cast("int"))) / 2
    return rows.withColumn("mid", mid).selectExpr("url", "seq", _ANOMALY)
