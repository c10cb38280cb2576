"""Queries that write tables more than once and read them back: alerts as a log of changes, snapshots by month, lifecycles from appended scans, hashes seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.functions import text as tx
from tidemark.operators import series
from tidemark.operators.seen import SeenSet
from tidemark.operators.stored import ChangeLog, PartitionedTable
from tidemark.plans.define import query, split
from tidemark.plans.series_queries import _LIFE, _LIFE1, _SNAP, SNAP, _slope_signal
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import load

_r = fx.rounded


# An event about an alert: an error deletes it, others set what they know of it.
_ALERT = {
    "name": "CASE WHEN event_type = 'signup' THEN concat('alert-', cast(event_id AS {text})) END",
    "threshold": "CASE WHEN event_type IN ('view', 'purchase') THEN value END",
    "rule": "CASE WHEN event_type = 'click' THEN {json} END",
}


@query("q_alert_log", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {", ".join(f"{x.format(text='VARCHAR', json="CAST(json_extract(props, '$.k') AS BIGINT)")} AS {n}" for n, x in _ALERT.items())} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT e.*, coalesce(max(CASE WHEN event_type = 'error' THEN i END) OVER (PARTITION BY user_id), 0) AS gone FROM e)
SELECT user_id, {", ".join(f"arg_max({n}, i) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in _ALERT)}, arg_max(event_id, i) AS updated_by FROM g WHERE i > gone GROUP BY user_id""")
def q_alert_log(spark, sf_dir):
    """Alerts by user from changes in five batches: the third comes before the second, one comes twice, and twice the log is folded."""
    rule = F.struct(F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    values = [F.when(F.col("event_type") == "click", rule).alias(n) if n == "rule" else F.expr(x.format(text="string")).alias(n) for n, x in _ALERT.items()]
    changes = events.where("ts IS NOT NULL").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), *values, F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4)).alias("part"))
    log = ChangeLog(spark, shared_folder(spark, "alerts"), ["user_id"], ["ts", "event_id"], changes.drop("part").schema)
    for batch, part in enumerate((0, 2, 1, 3, 3, 4)):
        log.append(batch, changes.where(F.col("part") == part).drop("part"))
        if batch in (1, 3):
            log.compact()
    return log.read().select("user_id", "name", "threshold", F.col("rule.k").alias("rule"), F.col("_last.event_id").alias("updated_by"))


_FIRST_MONTH, _SEEN_UNTIL = "1999-11", "2000-01-15"


@query("q_snapshot_partitions", f"WITH {SNAP} SELECT * REPLACE (strftime(month, '%Y-%m') AS month) FROM (SELECT {_SNAP} FROM snap) WHERE month >= DATE '{_FIRST_MONTH}-01'")
def q_snapshot_partitions(spark, sf_dir):
    """Snapshots by month: written with the lines until the middle of a month, that month and later ones again with all lines, and old months dropped by name."""
    table = PartitionedTable(spark, shared_folder(spark, "snapshots"), "month")
    shown = lambda seen: series.monthly_snapshots(spark, sf_dir, seen).selectExpr(*split(_SNAP)).withColumn("month", F.date_format("month", "yyyy-MM")).repartitionByRange("month", "product_id")
    old = shown(f"l_shipdate < timestamp_ntz '{_SEEN_UNTIL}'")
    table.write(old)
    table.write(shown(f"l_shipdate >= timestamp_ntz '{_SEEN_UNTIL[:8]}01'"))
    table.drop_before(_FIRST_MONTH)
    return table.read(old.schema)


_SCANS = ("2001-02-05", "2001-05-05", "2001-08-05", "2001-11-05")
_OFFER = "max(usd) * 0.85 - min(usd) AS profit, CAST(count(*) AS DOUBLE) AS comp"


def active_offers(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """Products with a profit between listings not older than 400 days at a day: product_id, profit, comp (listings), scan."""
    lines = load(spark, sf_dir, "lineitem").where(f"l_shipdate <= timestamp_ntz '{day}' AND l_shipdate > timestamp_ntz '{day}' - INTERVAL 400 DAYS")
    latest = lines.groupBy(F.col("l_partkey").alias("product_id"), "l_suppkey").agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("usd"))
    return latest.groupBy("product_id").agg(*[F.expr(c) for c in split(_OFFER)]).where("profit > 5").withColumn("scan", F.lit(day))


def lifecycles(snapshots: DataFrame, now: str, latest: int = 100) -> DataFrame:
    """Decay, urgency and label of what the scan ``now`` found active, from its latest snapshots(product_id, profit, comp, scan)."""
    by = Window.partitionBy("product_id")
    last = snapshots.where(F.col("scan") <= now).withColumn("rn", F.row_number().over(by.orderBy(F.desc("scan")))).where(F.col("rn") <= latest).withColumn("i", -F.col("rn").cast("double"))
    signals = [F.expr(_slope_signal(f"regr_slope({c}, i)", f"avg({c})", "count(*)")).alias(f"{c}_signal") for c in ("profit", "comp")]
    told = last.groupBy("product_id").agg(F.count("*").alias("n"), F.max("scan").alias("seen"), F.expr(f"datediff(date '{now}', cast(min(scan) AS date)) * 24 AS hours"), *signals).where(F.col("seen") == now)
    return told.selectExpr(*split(_LIFE1.replace("o_custkey", "product_id"))).selectExpr(*split(_LIFE.replace("o_custkey", "product_id")))


def _offers_sql(day: str) -> str:
    return f"SELECT product_id, {_OFFER}, '{day}' AS scan FROM (SELECT l_partkey AS product_id, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS usd FROM lineitem WHERE l_shipdate <= TIMESTAMP '{day}' AND l_shipdate > TIMESTAMP '{day}' - INTERVAL 400 DAYS GROUP BY l_partkey, l_suppkey) GROUP BY product_id HAVING profit > 5"


@query("q_lifecycle_history", f"""WITH l AS ({" UNION ALL ".join(map(_offers_sql, _SCANS))}), i AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY scan) AS DOUBLE) AS i FROM l),
s AS (SELECT product_id, count(*) AS n, date_diff('day', CAST(min(scan) AS DATE), DATE '{_SCANS[-1]}') * 24 AS hours, {_slope_signal('regr_slope(profit, i)', 'avg(profit)', 'count(*)')} AS profit_signal, {_slope_signal('regr_slope(comp, i)', 'avg(comp)', 'count(*)')} AS comp_signal FROM i GROUP BY product_id HAVING max(scan) = '{_SCANS[-1]}')
SELECT {_LIFE.replace("o_custkey", "product_id")} FROM (SELECT {_LIFE1.replace("o_custkey", "product_id")} FROM s)""")
def q_lifecycle_history(spark, sf_dir):
    """Each of four scans appends what it finds active to one table, one scan twice; the last one's lifecycles come from what was appended."""
    table, offers = PartitionedTable(spark, shared_folder(spark, "lifecycle"), "scan"), None
    for day in (*_SCANS[:3], _SCANS[2], _SCANS[3]):
        offers = active_offers(spark, sf_dir, day)
        table.write(offers)
    return lifecycles(table.read(offers.schema), _SCANS[-1])


_BATCHES = "CASE WHEN year(l_shipdate) < 1998 THEN 0 WHEN year(l_shipdate) < 2000 THEN 1 ELSE 2 END"
_V1 = "substr(sha256(concat_ws('|', trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')), l_returnflag, concat(CAST(CAST(floor(price) AS BIGINT) AS VARCHAR), '.00'))), 1, 16)"
_V2 = "sha256(concat_ws('|', lower(p_name), l_returnflag, CAST(CAST(floor(price) AS BIGINT) AS VARCHAR)))"


@query("q_seen_set", f"""WITH r AS (SELECT {_BATCHES} AS batch, l_orderkey, l_linenumber, p_name, l_returnflag, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate IS NOT NULL)
SELECT CAST(batch AS INTEGER) AS batch, l_orderkey, l_linenumber, {_V1} AS hash, {_V2} AS hash_v2 FROM r QUALIFY row_number() OVER (PARTITION BY {_V1} ORDER BY batch, l_orderkey, l_linenumber) = 1""")
def q_seen_set(spark, sf_dir):
    """Offers whose title, market and whole price no run before has seen, over three runs of years; the second runs twice."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").selectExpr("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "floor(l_extendedprice / l_quantity) AS price", f"{_BATCHES} AS batch")
    of = (F.col("p_name"), F.col("l_returnflag"), F.col("price"))
    hashed = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("batch", "l_orderkey", "l_linenumber", tx.listing_hash(*of).alias("hash"), tx.listing_hash_v2(*of).alias("hash_v2"))
    seen, new = SeenSet(spark, shared_folder(spark, "seen")), {}
    for k in (0, 1, 1, 2):
        new[k] = seen.add(k, hashed.where(F.col("batch") == k), "hash", ["l_orderkey", "l_linenumber"])
    return new[0].unionByName(new[1]).unionByName(new[2])
