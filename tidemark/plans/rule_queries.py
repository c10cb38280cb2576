"""Queries of single rules: variants, sanity of prices, repeats in time, capital and risk gates, rankings, sinks, small reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.functions import variants as va
from tidemark.plans.define import ORACLES, QUERIES, query, split
from tidemark.plans.scan_queries import opps
from tidemark.plans.scan_sql import upto
from tidemark.plans.series_queries import _forecast_sql, q_forecast_ols
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import load, price_history

_r = fx.rounded


def over_opps(name: str, columns: str, doc: str, where: str = "TRUE"):
    """A query of opportunities whose select list both engines read as it stands."""

    def run(spark, sf_dir):
        return opps(spark, sf_dir).where(where).selectExpr(*split(columns))

    run.__doc__ = doc
    query(name, upto("opps", f"SELECT {columns} FROM opps WHERE {where}"))(run)


def reasons(tests: dict[str, str]) -> str:
    """Names of the tests that hold, in order."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in tests.items()) + ")"


# Variants. Parts stand for listings; their numbers make titles of models, capacities, bundles and accessories.
_TITLE = (
    "CASE p_partkey % 12 WHEN 0 THEN concat('iPhone ', {size}, CASE WHEN p_size > 25 THEN ' Pro' ELSE '' END, ' ', CASE p_size % 3 WHEN 0 THEN '64 GB' WHEN 1 THEN '128GB' ELSE '1 TB' END) WHEN 1 THEN concat('Funda para iPhone ', {size})"
    " WHEN 2 THEN concat('Audifonos WH-', {size}, '00XM', {size}, ' ', p_name) WHEN 3 THEN concat('Garmin Edge ', {size}, '0') WHEN 4 THEN concat('Power bank ', CASE p_size % 2 WHEN 0 THEN '10000 mAh' ELSE '20000mah' END)"
    " WHEN 5 THEN concat('Consola PS5 ', CASE p_size % 3 WHEN 0 THEN 'con disco' WHEN 1 THEN 'edición digital' ELSE 'slim' END) WHEN 6 THEN concat('Teclado para ', CASE p_size % 2 WHEN 0 THEN 'el iPad' ELSE 'iMac' END) WHEN 7 THEN concat('Kit de ', p_name)"
    " WHEN 8 THEN concat(p_name, ' Renewed') WHEN 9 THEN concat('Galaxy S', {size}, ' Ultra') ELSE p_name END"
)
_CONDITION = "CASE WHEN p_partkey % 5 = 0 THEN 'used' ELSE 'new' END"
_TEXT = {"string": _TITLE.format(size="cast(p_size AS string)"), "VARCHAR": _TITLE.format(size="cast(p_size AS VARCHAR)")}
_FEATURE_COLUMNS = ("condition", "low", "model", "numbers", "targets", "words", *va.SHARED)
_SIDE_SQL = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "bs" for c in _FEATURE_COLUMNS)
_SIZES_SQL = ", ".join(f"len({s}.{c}) AS {s}_n_{c}" for s in "bs" for c in ("numbers", "targets", "words"))


@query("q_variant_compat", f"""WITH t AS (SELECT p_partkey, p_brand, {_TEXT['VARCHAR']} AS title, {_CONDITION} AS condition FROM part), f AS (SELECT *, {va.features_sql('title')} FROM t), g AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in va.SHARED.items())} FROM f),
j AS (SELECT b.p_partkey AS a, s.p_partkey AS b, {_SIDE_SQL}, {_SIZES_SQL}, len(list_intersect(b.numbers, s.numbers)) AS n_numbers, len(list_intersect(b.words, s.words)) AS n_words FROM g b JOIN g s ON b.p_brand = s.p_brand AND b.p_partkey <> s.p_partkey WHERE b.p_partkey % 100 = 0)
SELECT a, b, {va.COMPATIBLE} AS compatible, {va.SAME_TITLE} AS same_title FROM j""")
def q_variant_compat(spark, sf_dir):
    """Nine rules of variants and the title match, for every hundredth part against all others of its brand."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_TEXT["string"]).alias("title"), F.expr(_CONDITION).alias("condition"))
    buys, sells = va.sides(va.with_features(rows, "title").drop("title"), ["p_brand"])
    pairs = buys.where("b_p_partkey % 100 = 0").join(sells, "p_brand").where("b_p_partkey <> s_p_partkey")
    return va.judged(pairs).select(F.col("b_p_partkey").alias("a"), F.col("s_p_partkey").alias("b"), "compatible", "same_title")


@query("q_model_ids", f"SELECT p_partkey, model, array_to_string(list_sort(numbers), ',') AS numbers, CASE WHEN accessory THEN 'accessory' ELSE 'main' END AS kind FROM (SELECT *, {va.SHARED['accessory']} AS accessory FROM (SELECT p_partkey, {va.features_sql('title')} FROM (SELECT p_partkey, {_TEXT['VARCHAR']} AS title FROM part)))")
def q_model_ids(spark, sf_dir):
    """The model identifier of each title by ordered patterns, and the set of its model numbers."""
    rows = va.with_features(load(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXT["string"]).alias("title")), "title")
    return rows.select("p_partkey", "model", F.array_join(F.array_sort("numbers"), ",").alias("numbers"), F.expr("CASE WHEN accessory THEN 'accessory' ELSE 'main' END").alias("kind"))


# Numbers whose separators are ambiguous.
_DOTS, _COMMAS = "(length(x) - length(replace(x, '.', '')))", "(length(x) - length(replace(x, ',', '')))"
_AMBIGUOUS = (
    f"CASE WHEN {_DOTS} > 0 AND {_COMMAS} > 0 THEN CASE WHEN instr(reverse(x), '.') < instr(reverse(x), ',') THEN replace(x, ',', '') ELSE replace(replace(x, '.', ''), ',', '.') END"
    f" WHEN {_DOTS} > 1 THEN replace(x, '.', '') WHEN {_DOTS} = 1 AND instr(reverse(x), '.') = 4 THEN replace(x, '.', '') WHEN {_DOTS} = 1 THEN x"
    f" WHEN {_COMMAS} > 1 THEN replace(x, ',', '') WHEN {_COMMAS} = 1 AND instr(reverse(x), ',') <= 3 THEN replace(x, ',', '.') ELSE replace(x, ',', '') END"
)
_WRITTEN = "CASE l_linenumber % 7 WHEN 0 THEN concat({k}, '.', {t}) WHEN 1 THEN concat({k}, ',', {t}) WHEN 2 THEN concat({k}, '.', {t}, ',5') WHEN 3 THEN concat({k}, ',', {t}, '.25') WHEN 4 THEN concat({k}, ',7') WHEN 5 THEN concat({k}, '.', {t}, '.', {t}) ELSE concat({k}, ',', {t}, ',', {t}) END"


def _written(kind: str) -> str:
    return _WRITTEN.format(k=f"cast(l_orderkey AS {kind})", t=f"cast(100 + l_partkey % 900 AS {kind})")


@query("q_ambiguous_numbers", f"SELECT l_orderkey, l_linenumber, x AS raw, TRY_CAST({_AMBIGUOUS} AS DOUBLE) AS amount FROM (SELECT l_orderkey, l_linenumber, {_written('VARCHAR')} AS x FROM lineitem)")
def q_ambiguous_numbers(spark, sf_dir):
    """Amounts written without a known convention: the last of two kinds of separator is the decimal one, three digits after a single one make it thousands."""
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_written('string')} AS x")
    return rows.select("l_orderkey", "l_linenumber", F.col("x").alias("raw"), F.expr(f"try_cast({_AMBIGUOUS} AS double)").alias("amount"))


_SANE = f"product_id, seq, {_r('usd', 4)} AS usd, usd BETWEEN 1e0 AND 20000e0 AND (n < 3 OR mid <= 0 OR abs(usd - mid) / mid <= 8e-1) AS sane, usd <= 0 OR mid <= 0 OR n < 3 OR greatest(usd, mid) / least(usd, mid) <= 35e-1 AS near_median"


@query("q_usd_sanity", f"SELECT {_SANE} FROM (SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS usd FROM lineitem) JOIN (SELECT l_partkey AS product_id, count(*) AS n, median(l_extendedprice / l_quantity) AS mid FROM lineitem GROUP BY l_partkey) USING (product_id)")
def q_usd_sanity(spark, sf_dir):
    """Each price against bounds and its product's median: within 80 %, and within 3.5 times; products of fewer than three prices pass."""
    prices = price_history(spark, sf_dir).select("product_id", "seq", F.col("price_usd").alias("usd"))
    mids = prices.groupBy("product_id").agg(F.count("*").alias("n"), F.median("usd").alias("mid"))
    return prices.join(mids, "product_id").selectExpr(*split(_SANE))


def kept_after_gap(rows: DataFrame, key: str, at: str, seq: str, window: int) -> DataFrame:
    """key, at, seq and kept of each row: false if the key's last kept row is at most ``window`` seconds back.

    A suppressed row does not move the anchor, so this is a fold: rows are shuffled by key and sorted, each task holds
    the last anchor of one key and jumps from anchor to anchor.
    """

    def fold(batches):
        last_key, anchor = None, None
        for batch in batches:
            keys, times = np.array(batch["_key"].to_pylist(), dtype=object), batch["_us"].to_numpy()
            kept = np.zeros(len(times), bool)
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)] if len(keys) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if keys[i] != last_key:
                    last_key, anchor = keys[i], None
                k = i if anchor is None else i + int(np.searchsorted(times[i:j], anchor + window * 1_000_000, side="right"))
                while k < j:
                    kept[k], anchor = True, times[k]
                    k += int(np.searchsorted(times[k:j], anchor + window * 1_000_000, side="right"))
            yield pa.RecordBatch.from_arrays([batch["_key"], batch["_us"], batch["_seq"], pa.array(kept)], ["_key", "_us", "_seq", "kept"])

    sorted_ = rows.select(F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), F.col(seq).cast("long").alias("_seq"))
    sorted_ = sorted_.repartition("_key").sortWithinPartitions("_key", "_us", "_seq")
    return sorted_.mapInArrow(fold, "_key string, _us long, _seq long, kept boolean").select(F.col("_key").alias(key), F.timestamp_micros("_us").alias(at), F.col("_seq").alias(seq), "kept")


@query("q_time_gap_dedup", """WITH RECURSIVE e AS MATERIALIZED (SELECT concat(user_id, '-', event_type) AS k, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY concat(user_id, '-', event_type) ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
a AS (SELECT k, event_id, us, i FROM e WHERE i = 1 UNION ALL SELECT n.k, n.event_id, n.us, n.i FROM (SELECT a.k, arg_min(e, (e.us, e.event_id)) AS n FROM a JOIN e ON e.k = a.k AND e.us > a.us + 86400000000 GROUP BY a.k))
SELECT e.k AS entity, e.event_id, a.event_id IS NOT NULL AS kept FROM e LEFT JOIN a ON a.k = e.k AND a.event_id = e.event_id""")
def q_time_gap_dedup(spark, sf_dir):
    """Repeats of a user's event within a day of the last one kept are suppressed."""
    rows = load(spark, sf_dir, "events").where("ts IS NOT NULL").select(F.concat_ws("-", "user_id", "event_type").alias("entity"), "event_id", "ts")
    return kept_after_gap(rows, "entity", "ts", "event_id", 86400).drop("ts")


# Capital.
_RANKED = "confidence_score / 100 * net_profit * greatest(1e-2, 1 - risk_score / 100)"
_SCALE = _r("CASE WHEN confidence_score / 100 >= 8e-1 THEN 1e0 ELSE 5e-1 + 5e-1 * (confidence_score / 100) / 8e-1 END", 4)
_PLACED = f"product_id, place, {_SCALE} AS size_scale, place <= 5 AS taken, CASE WHEN place > 5 THEN concat('ranked ', cast(place AS {{text}}), ' > top_k=5') END AS reason"


@query("q_capital_rank", upto("opps", f"SELECT {_PLACED.format(text='VARCHAR')} FROM (SELECT *, row_number() OVER (PARTITION BY sell_mp ORDER BY {_r(_RANKED, 4)} DESC, product_id) AS place FROM opps)"))
def q_capital_rank(spark, sf_dir):
    """Candidates of each marketplace by confidence, profit and risk: the best five are taken, the others told their rank; sizes shrink with confidence."""
    w = Window.partitionBy("sell_mp").orderBy(F.expr(_r(_RANKED, 4)).desc(), "product_id")
    return opps(spark, sf_dir).withColumn("place", F.row_number().over(w)).selectExpr(*split(_PLACED.format(text="string")))


# A customer's orders as trades: the key gives each one a profit or a loss.
_TRADE = "o_custkey, o_orderkey, o_orderdate, (o_orderkey % 11 - 5) * o_totalprice / 1000 AS pnl"
_BOOK = """SELECT o_custkey, max(n) AS n, 5000 + max(CASE WHEN back = 1 THEN total END) AS capital, 5000 + greatest(0e0, max(total)) AS peak, count(CASE WHEN pnl > 0 THEN 1 END) AS wins,
 -sum(CASE WHEN pnl < 0 AND day = last_day THEN pnl ELSE 0e0 END) AS day_loss, max(CASE WHEN pnl < 0 THEN o_orderdate END) AS last_loss, min(CASE WHEN pnl >= 0 THEN back END) AS first_gain FROM w GROUP BY o_custkey"""
_BOOK_ROWS = """SELECT *, sum(pnl) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back,
 count(*) OVER (PARTITION BY o_custkey) AS n, CAST(o_orderdate AS DATE) AS day, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS last_day FROM t"""
_STREAK = "coalesce(first_gain, n + 1) - 1"
_DRAWDOWN = "(peak - capital) / peak"
#: An hour before the moment asked for, 2001-08-02, where a day of the tables stands for a minute.
COOLED = "2001-06-03"
# The balanced profile's limits on drawdown, loss of capital and loss of a day, and its pause after a loss.
_HALTS = {"drawdown": f"{_DRAWDOWN} >= 2e-1", "capital_stop_loss": "(peak - capital) / peak >= 15e-2", "daily_loss": "day_loss >= 500e0", "cooldown": f"last_loss > CAST('{COOLED}' AS DATE)"}
_HALT = " OR ".join(f"coalesce({e}, FALSE)" for e in _HALTS.values())
#: A streak of losses shrinks sizes without a halt; it is told before the pause.
_TOLD = {**{k: e for k, e in _HALTS.items() if k != "cooldown"}, "loss_streak": f"{_STREAK} >= 3", "cooldown": _HALTS["cooldown"]}
_STOPS = {"drawdown": f"{_DRAWDOWN} >= 15e-2", "daily_loss": "capital > 0 AND day_loss >= capital * 5e-2", "win_rate": "n >= 10 AND wins * 1e0 / n < 5e-1"}
_RISK = (
    f"o_custkey, {_r(_DRAWDOWN, 4)} AS drawdown, {_STREAK} AS losses, NOT ({_HALT}) AS can_execute, CASE WHEN {_STREAK} >= 3 THEN 5e-1 ELSE 1e0 END AS factor,"
    f" CASE WHEN {_HALT} THEN 'critical' WHEN {_STREAK} >= 3 THEN 'high' WHEN {_DRAWDOWN} > 1e-1 THEN 'medium' ELSE 'low' END AS level, {reasons(_TOLD)} AS reasons, {reasons(_STOPS)} AS stops"
)
_GUARD = f"o_custkey, CASE WHEN {_HALT} THEN 'risk' WHEN capital * 2e-1 * CASE WHEN {_STREAK} >= 3 THEN 5e-1 ELSE 1e0 END < 20 THEN 'sizing' WHEN n >= 15 THEN 'diversification' WHEN least(capital * 2e-1, 500e0) > capital - 400 THEN 'capital' END AS failed_gate"


def _books(spark, sf_dir):
    return spark.sql(f"WITH t AS (SELECT * FROM {{trades}}), w AS ({_BOOK_ROWS}) {_BOOK}", trades=load(spark, sf_dir, "orders").selectExpr(*split(_TRADE)))


_BOOKS_SQL = f"WITH t AS (SELECT {_TRADE} FROM orders), w AS ({_BOOK_ROWS}), book AS ({_BOOK})"


@query("q_risk_manager", f"{_BOOKS_SQL} SELECT {_RISK} FROM book")
def q_risk_manager(spark, sf_dir):
    """Circuit breakers, loss streak, cooldown and stop conditions of each customer's book; risk level by the worst."""
    return _books(spark, sf_dir).selectExpr(*split(_RISK))


@query("q_guard_chain", f"{_BOOKS_SQL} SELECT {_GUARD} FROM book")
def q_guard_chain(spark, sf_dir):
    """The first gate that fails, of risk, sizing, diversification and capital in this order; null where all pass."""
    return _books(spark, sf_dir).selectExpr(*split(_GUARD))


# Execution.
_LATENCY = "(product_id * 7 % 420) * 1e0"
_NOW = "(buy_usd * (1 + (product_id % 17 - 8) / 100e0))"
_DELTA, _LEFT = f"({_NOW} - buy_usd) / buy_usd", f"(sell_usd - {_NOW} - fees)"
over_opps(
    "q_execution_checks",
    f"product_id, {_LATENCY} <= 300 AS in_time, CASE WHEN {_LATENCY} > 300 THEN 1e0 WHEN {_LATENCY} > 120 THEN {_r(f'least(1e0, ({_LATENCY} - 120) / 60 * 3e-2)', 4)} ELSE 0e0 END AS latency_penalty,"
    f" {_r(_DELTA, 4)} AS delta, {_r(_LEFT, 2)} AS profit_now, abs({_DELTA}) <= 5e-2 AND {_LEFT} >= 5 AS price_valid, buy_usd <= 50 AND risk_score <= 40 AS auto_approved",
    "Latency and its penalty, the price asked again, and what is approved without a person.",
)
over_opps("q_trade_deviation", f"product_id, CASE WHEN net_profit > 0 THEN {_r('(net_profit * (1 - risk_score / 200) - net_profit) / net_profit * 100', 2)} ELSE 0e0 END AS deviation", "Actual against estimated profit in per cent.")


@query("q_prediction_direction", upto("opps", f"SELECT product_id, predicted, CASE WHEN predicted > 0 AND sell_usd > 0 AND (predicted - sell_usd) / sell_usd > 2e-2 THEN 'rising' WHEN predicted > 0 AND sell_usd > 0 AND (predicted - sell_usd) / sell_usd < -2e-2 THEN 'falling' ELSE 'stable' END AS direction FROM opps LEFT JOIN ({_forecast_sql('l_partkey')}) f USING (product_id)"))
def q_prediction_direction(spark, sf_dir):
    """The forecast of each opportunity's product against its sell price, two per cent either way."""
    both = opps(spark, sf_dir).select("product_id", "sell_usd").join(q_forecast_ols(spark, sf_dir).select("product_id", "predicted"), "product_id", "left")
    change, known = (F.col("predicted") - F.col("sell_usd")) / F.col("sell_usd"), (F.col("predicted") > 0) & (F.col("sell_usd") > 0)
    return both.select("product_id", "predicted", F.when(known & (change > 0.02), "rising").when(known & (change < -0.02), "falling").otherwise("stable").alias("direction"))


# Rankings and lists.
_MODES = {"score": "opportunity_score", "roi": "roi", "profit": "net_profit", "created": "sell_at"}


@query("q_sort_modes", upto("opps", " UNION ALL ".join(f"SELECT '{m}' AS mode, product_id, place FROM (SELECT product_id, row_number() OVER (ORDER BY {c} DESC, product_id) AS place FROM opps) WHERE place <= 10" for m, c in _MODES.items())))
def q_sort_modes(spark, sf_dir):
    """The ten best opportunities under each order the dashboard offers; a top-k report."""
    found = opps(spark, sf_dir).select("product_id", *_MODES.values())
    top = [found.orderBy(F.desc(c), "product_id").limit(10).select(F.lit(m).alias("mode"), "product_id", F.row_number().over(Window.orderBy(F.desc(c), "product_id")).alias("place")) for m, c in _MODES.items()]
    return reduce(DataFrame.unionByName, top)


@query("q_id_union", upto("opps", "SELECT buy_url AS id FROM opps UNION SELECT sell_url FROM opps UNION SELECT CAST(product_id AS VARCHAR) FROM opps"))
def q_id_union(spark, sf_dir):
    """All ids that a page of opportunities needs, once each."""
    return opps(spark, sf_dir).select(F.explode(F.array("buy_url", "sell_url", F.col("product_id").cast("string"))).alias("id")).distinct()


@query("q_top_trends", f"SELECT * FROM ({ORACLES['q_trend_score_label']}) ORDER BY trend_score DESC, product_id LIMIT 20")
def q_top_trends(spark, sf_dir):
    """The twenty products of the highest trend score; a top-k report."""
    return QUERIES["q_trend_score_label"](spark, sf_dir).orderBy(F.desc("trend_score"), "product_id").limit(20)


@query("q_rejections", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM ({ORACLES['q_gate_filters']})) WHERE reason <> '' GROUP BY reason")
def q_rejections(spark, sf_dir):
    """How often each gate rejects."""
    told = QUERIES["q_gate_filters"](spark, sf_dir).select(F.explode(F.split("reasons", "; ")).alias("reason")).where("reason <> ''")
    return told.groupBy("reason").agg(F.count("*").alias("n"))


# Categories: yield, pages and order, from a decayed cycle of counters.
_COUNTERS = "p_type AS category, count(*) AS total, count(CASE WHEN p_size > 20 THEN 1 END) AS found, count(CASE WHEN p_size > 35 THEN 1 END) AS profitable, avg(p_size) / 100e0 AS roi, max(p_size % 4) AS cycles"
_DECAYED = "category, floor(total * 9e-1) AS total, floor(found * 9e-1) AS found, floor(profitable * 9e-1) AS profitable, roi, cycles"
_YIELD = "CASE WHEN cycles = 0 THEN 0e0 ELSE found / greatest(cycles, 1) * 4e-1 + profitable / greatest(cycles, 1) * 6e-1 + roi * 10 END"
_PAGES = "CASE WHEN score / CASE WHEN best = 0 THEN 1e0 ELSE best END > 7e-1 THEN 20 WHEN score / CASE WHEN best = 0 THEN 1e0 ELSE best END < 2e-1 THEN 5 ELSE 10 END"
_ORDER = "CASE WHEN cycles = 0 THEN floor(known / 2) ELSE place END"
_YIELD_SQL = f"WITH c AS (SELECT {_COUNTERS} FROM part GROUP BY p_type), d AS (SELECT {_DECAYED} FROM c), y AS (SELECT *, {_r(_YIELD, 4)} AS score FROM d), z AS (SELECT *, max(score) OVER () AS best, count(CASE WHEN cycles > 0 THEN 1 END) OVER () AS known, row_number() OVER (ORDER BY CASE WHEN cycles > 0 THEN 0 ELSE 1 END, score DESC, category) AS place FROM y)"
_YIELD_OUT = f"category, score, {_PAGES} AS pages, row_number() OVER (ORDER BY {_ORDER}, CASE WHEN cycles = 0 THEN 1 ELSE 0 END, place) AS turn"


@query("q_category_yield", f"{_YIELD_SQL} SELECT {_YIELD_OUT} FROM z")
def q_category_yield(spark, sf_dir):
    """Yield of each category from decayed counters, its pages of the next cycle and its turn; categories without a cycle come in the middle. One row per category is ranked."""
    return spark.sql(f"{_YIELD_SQL.replace('FROM part ', 'FROM {part} ')} SELECT {_YIELD_OUT} FROM z", part=load(spark, sf_dir, "part"))


# Sources and sinks.
@query("q_partitioned_append", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(CASE WHEN l_linenumber > 1 THEN 1 END) AS n_later FROM lineitem GROUP BY 1")
def q_partitioned_append(spark, sf_dir):
    """Prices appended by month in two batches, then one month overwritten by itself (dynamic overwrite), and read back."""
    path = shared_folder(spark, "history")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    rows.where("l_linenumber = 1").repartition("month").write.partitionBy("month").parquet(path)
    rows.where("l_linenumber > 1").repartition("month").write.mode("append").partitionBy("month").parquet(path)
    rows.where("month = '1998-05'").repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    written = spark.read.schema("l_orderkey long, l_linenumber int, month string").parquet(path)
    return written.groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") > 1).alias("n_later"))


@query("q_denormalised_update", "SELECT p_partkey, coalesce(n, 0) AS n_listings, coalesce(least, p_retailprice) AS least_usd FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_extendedprice / l_quantity) AS least FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-01' GROUP BY l_partkey) ON l_partkey = p_partkey")
def q_denormalised_update(spark, sf_dir):
    """Product counters from the latest lines; what no line speaks of keeps its old value."""
    new = load(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2001-09-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("least"))
    return load(spark, sf_dir, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_listings"), F.coalesce("least", "p_retailprice").alias("least_usd"))


_JSON = "concat('{{\"props\":{{\"items\":[{{\"productId\":\"', cast(p_partkey AS {text}), '\",\"title\":{{\"displayTitle\":\"', p_name, '\"}},\"prices\":{{\"', CASE p_partkey % 3 WHEN 0 THEN 'salePrice\":{{\"minPrice\":\"US $' WHEN 1 THEN 'other\":{{\"x\":\"' ELSE 'salePrice\":{{\"y\":\"' END, cast(p_size AS {text}), '.50\"}}}},\"minPrice\":', cast(p_size AS {text}), ',\"tradeDesc\":\"', cast(p_size * 3 AS {text}), ' sold\",\"logistics\":\"', CASE WHEN p_size % 2 = 0 THEN 'Free shipping' ELSE 'from $3' END, '\"}}]}}}}')"
_PAGE = "concat('<html><script id=\"__NEXT_DATA__\" type=\"application/json\">', {json}, '</script></html>')"
_ITEM = "$.props.items[0]"


@query("q_embedded_json", f"""WITH j AS (SELECT regexp_extract({_PAGE.format(json=_JSON.format(text='VARCHAR'))}, '__NEXT_DATA__"[^>]*>(.*?)</script>', 1) AS j FROM part)
SELECT json_extract_string(j, '{_ITEM}.productId') AS item, json_extract_string(j, '{_ITEM}.title.displayTitle') AS title, TRY_CAST(regexp_replace(coalesce(json_extract_string(j, '{_ITEM}.prices.salePrice.minPrice'), json_extract_string(j, '{_ITEM}.minPrice')), '[^0-9.]', '', 'g') AS DOUBLE) AS price,
CAST(regexp_extract(json_extract_string(j, '{_ITEM}.tradeDesc'), '[0-9]+') AS BIGINT) AS orders, regexp_matches(lower(json_extract_string(j, '{_ITEM}.logistics')), 'free|gratis') AS free_ship FROM j""")
def q_embedded_json(spark, sf_dir):
    """Listings from the JSON that a page embeds, with fallbacks for the price."""
    data = load(spark, sf_dir, "part").select(F.regexp_extract(F.expr(_PAGE.format(json=_JSON.format(text="string"))), '__NEXT_DATA__"[^>]*>(.*?)</script>', 1).alias("j"))
    of = lambda path: F.get_json_object("j", f"{_ITEM}.{path}")
    price = F.regexp_replace(F.coalesce(of("prices.salePrice.minPrice"), of("minPrice")), "[^0-9.]", "").try_cast("double")
    return data.select(of("productId").alias("item"), of("title.displayTitle").alias("title"), price.alias("price"), F.regexp_extract(of("tradeDesc"), "[0-9]+", 0).cast("long").alias("orders"), F.lower(of("logistics")).rlike("free|gratis").alias("free_ship"))


@query("q_json_fallback", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.buy_price') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS price FROM events")
def q_json_fallback(spark, sf_dir):
    """A field, another where it is absent, or nothing."""
    of = lambda path: F.get_json_object("props", path).try_cast("double")
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(of("$.buy_price"), of("$.k"), F.lit(0.0)).alias("price"))


_ISO = "CASE event_id % 4 WHEN 0 THEN concat({t}, 'Z') WHEN 1 THEN concat({t}, {zone}) WHEN 2 THEN {t} ELSE 'soon' END"


@query("q_iso_times", f"SELECT event_id, epoch_us(TRY_CAST({_ISO.format(t="strftime(ts, '%Y-%m-%dT%H:%M:%S')", zone="''")} AS TIMESTAMP)) - CASE WHEN event_id % 4 = 1 THEN 7200000000 ELSE 0 END AS us, coalesce(TRY_CAST(regexp_replace(CASE event_id % 3 WHEN 0 THEN '30d' WHEN 1 THEN 'x' ELSE '14' END, 'd+$', '') AS INTEGER), 7) AS days FROM events WHERE ts IS NOT NULL")
def q_iso_times(spark, sf_dir):
    """ISO times with Z, with an offset and without (UTC), null where they are none; window strings in days, seven where they are none."""
    told = F.expr(_ISO.format(t="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", zone="'+02:00'"))
    zoned = F.when(told.rlike(r"(Z|[+-]\d\d:\d\d)$"), told).otherwise(F.concat(told, F.lit("Z")))
    days = F.regexp_replace(F.expr("CASE event_id % 3 WHEN 0 THEN '30d' WHEN 1 THEN 'x' ELSE '14' END"), "d+$", "").try_cast("int")
    return load(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", F.unix_micros(zoned.try_cast("timestamp")).alias("us"), F.coalesce(days, F.lit(7)).alias("days"))


@query("q_hosts", "SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://(?:[^@/]*@)?([^/:?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL")
def q_hosts(spark, sf_dir):
    """Hosts of URLs, without user and port."""
    return load(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+://(?:[^@/]*@)?([^/:?#]+)", 1).alias("host"))


# Channels with sets of classes and marketplaces; an empty set admits all.
_SETS = (("premium", ["PRIME"], []), ("latin", [], ["mercadolibre_mx", "mercadolibre_cl"]), ("all", [], []))
_SETS_SQL = ", ".join(f"('{n}', {{open}}{', '.join(repr(x) for x in c)}{{close}}, {{open}}{', '.join(repr(x) for x in m)}{{close}})" for n, c, m in _SETS)
_CLASS = fx.risk_class(fx.PROFILES["balanced"][1], "opportunity_score")


@query("q_channel_sets", upto("opps", f"SELECT channel, product_id FROM (SELECT *, {_CLASS} AS class FROM opps), (VALUES {_SETS_SQL.format(open='[', close=']::VARCHAR[]')}) c(channel, classes, mps) WHERE (len(classes) = 0 OR list_contains(classes, class)) AND (len(mps) = 0 OR list_contains(mps, sell_mp))"))
def q_channel_sets(spark, sf_dir):
    """Opportunities by channel, whose class and marketplace are in the channel's sets; three literal channels stack over each row."""
    rows = opps(spark, sf_dir).select("product_id", "sell_mp", F.expr(_CLASS).alias("class"))
    inside = lambda c, allowed: c.isin(*allowed) if allowed else F.lit(True)
    named = F.array(*[F.when(inside(F.col("class"), c) & inside(F.col("sell_mp"), m), F.lit(n)) for n, c, m in _SETS])
    return rows.select(F.explode(F.array_compact(named)).alias("channel"), "product_id")


# Reports.
_ALERTS = "l_shipmode AS mode, count(*) AS n, {rate} AS rate, {drift} AS drift, CASE WHEN count(*) < 5 THEN '' ELSE {told} END AS alerts".format(
    rate=_r("count(CASE WHEN l_returnflag <> 'R' THEN 1 END) * 1e0 / count(*)", 4),
    drift=_r("avg(l_extendedprice * (l_tax - l_discount))", 2),
    told=reasons({"success_rate": "count(CASE WHEN l_returnflag <> 'R' THEN 1 END) * 1e0 / count(*) < 7e-1", "drift": "abs(avg(l_extendedprice * (l_tax - l_discount)) / greatest(abs(avg(l_extendedprice * 1e-1)), 1e0)) * 100 > 20", "false_positives": "count(CASE WHEN l_returnflag = 'R' THEN 1 END) * 1e0 / count(*) > 3e-1"}),
)


@query("q_threshold_alerts", f"SELECT {_ALERTS.replace('l_shipmode', 'l_suppkey')} FROM lineitem GROUP BY l_suppkey")
def q_threshold_alerts(spark, sf_dir):
    """Alerts of each seller's trades: success rate, drift and false positives, from five trades on."""
    cols = split(_ALERTS.replace("l_shipmode", "l_suppkey"))
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.expr(c) for c in cols[1:]]).withColumnRenamed("l_suppkey", "mode")


_DEAD = "event_type, count(*) AS scraped, count(DISTINCT user_id) AS unique_users, count(*) - count(DISTINCT user_id) AS repeats, count(CASE WHEN event_id % 6 > 3 THEN 1 END) AS dead, count(CASE WHEN event_id % 6 <= 3 THEN 1 END) AS retried"


@query("q_dead_letters", f"SELECT {_DEAD} FROM events GROUP BY event_type")
def q_dead_letters(spark, sf_dir):
    """Deliveries split by their number of attempts (more than three are dead letters), with counters of repeats."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(*[F.expr(c) for c in split(_DEAD)[1:]])


_ACTIVE = "l_partkey AS product_id, count(*) AS n_listings, max(l_shipdate) AS updated"


@query("q_active_products", f"SELECT {_ACTIVE} FROM lineitem GROUP BY l_partkey HAVING max(l_shipdate) >= TIMESTAMP '2001-11-05' - INTERVAL 7 DAYS ORDER BY n_listings DESC, product_id LIMIT 50")
def q_active_products(spark, sf_dir):
    """Products with a listing updated within a week, the fifty with most of them; a top-k report."""
    by = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.count("*").alias("n_listings"), F.max("l_shipdate").alias("updated"))
    return by.where("updated >= timestamp_ntz '2001-11-05' - INTERVAL 7 DAYS").orderBy(F.desc("n_listings"), "product_id").limit(50)


_VERSION_SQL = """WITH v AS (SELECT o_custkey, o_orderpriority AS priority, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back, count(*) OVER (PARTITION BY o_custkey) AS version FROM orders)
SELECT a.o_custkey, a.version AS version, a.version + 1 AS rolled_back, b.priority AS restored_priority, b.status AS restored_status, concat_ws(',', CASE WHEN a.priority <> b.priority THEN 'priority' END, CASE WHEN a.status <> b.status THEN 'status' END) AS changed
FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND b.back = 2 WHERE a.back = 1"""


@query("q_config_versions", _VERSION_SQL)
def q_config_versions(spark, sf_dir):
    """A customer's orders as versions of a configuration: what the last one changed, and the version that rolling it back makes."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    rows = rows.withColumns({"version": F.row_number().over(w), "old_priority": F.lag("priority").over(w), "old_status": F.lag("status").over(w)})
    last = rows.groupBy("o_custkey").agg(F.max(F.struct("version", "priority", "status", "old_priority", "old_status")).alias("x")).select("o_custkey", "x.*").where("version > 1")
    changed = F.concat_ws(",", F.when(F.col("priority") != F.col("old_priority"), F.lit("priority")), F.when(F.col("status") != F.col("old_status"), F.lit("status")))
    return last.select("o_custkey", "version", (F.col("version") + 1).alias("rolled_back"), F.col("old_priority").alias("restored_priority"), F.col("old_status").alias("restored_status"), changed.alias("changed"))


_HEALTH = "event_type, count(*) AS n, {last} AS minutes, CASE WHEN {last} > 1440 THEN 'critical' WHEN {last} > 60 THEN 'warning' ELSE 'ok' END AS status, {eta} AS eta_minutes"
_SPAN = {"duckdb": ("floor((epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 60)", "(epoch(max(ts)) - epoch(min(ts))) / 60"), "spark": ("floor((unix_timestamp(timestamp_ntz '2024-02-01') - unix_micros(cast(max(ts) AS timestamp)) / 1e6) / 60)", "(unix_micros(cast(max(ts) AS timestamp)) - unix_micros(cast(min(ts) AS timestamp))) / 1e6 / 60")}


def _health(engine: str) -> str:
    last, span = _SPAN[engine]
    return _HEALTH.format(last=last, eta=_r(f"({span}) / greatest(count(*), 1) * (3000 - least(count(*), 3000))", 1))


_WORST = "CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END"


@query("q_health_rollup", f"WITH h AS (SELECT {_health('duckdb')} FROM events GROUP BY event_type) SELECT h.event_type, n, CAST(minutes AS BIGINT) AS minutes, status, eta_minutes, (SELECT {_WORST} FROM h) AS overall FROM h")
def q_health_rollup(spark, sf_dir):
    """Components by how stale they are, time left at the rate so far, and the worst status of all; one row per component."""
    by = load(spark, sf_dir, "events").groupBy("event_type").agg(*[F.expr(c) for c in split(_health("spark"))[1:]])
    return by.withColumn("minutes", F.col("minutes").cast("long")).withColumn("overall", F.expr(_WORST.replace("END) WHEN 2", "END) OVER () WHEN 2")))
