"""Recurrences over cycles: part types as categories, months as cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.cycles import PARAMETERS, calibrated, category_cycles
from tidemark.plans.define import query, split
from tidemark.sources.tables import load

_MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
# Averages are quotients of whole numbers, so both engines have the same.
_COUNTS = (
    "count(*) AS listings, count(CASE WHEN l_discount >= 5e-2 THEN 1 END) AS found, count(CASE WHEN l_discount > l_tax + 2e-2 THEN 1 END) AS profitable,"
    " cast(sum(cast(floor((l_discount - l_tax) * 1000 + 5e-1) AS bigint)) AS double) / count(*) / 1000 AS roi"
)
_SCORE = "CASE WHEN cycles = 0 THEN 0e0 ELSE found / cast(cycles AS double) * 4e-1 + profitable / cast(cycles AS double) * 6e-1 + roi * 10 END"
_PAGES = "CASE WHEN score / CASE WHEN best = 0 THEN 1e0 ELSE best END > 7e-1 THEN 20 WHEN score / CASE WHEN best = 0 THEN 1e0 ELSE best END < 2e-1 THEN 5 ELSE 10 END"
_OUT = f"category, cycle, total, found, profitable, cycles, floor(roi * 1e6 + 5e-1) / 1e6 AS roi, floor(score * 1e4 + 5e-1) / 1e4 AS score, {_PAGES} AS pages"

_SQL = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT p_type AS category, {_MONTH} AS cycle, {_COUNTS} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL GROUP BY ALL),
g AS MATERIALIZED (SELECT k.category, t.cycle, listings, found, profitable, roi FROM (SELECT category, unnest(range(min(cycle), (SELECT max(cycle) FROM c) + 1)) AS cycle FROM c GROUP BY category) t JOIN (SELECT DISTINCT category FROM c) k ON k.category = t.category LEFT JOIN c ON c.category = t.category AND c.cycle = t.cycle),
s AS (SELECT category, min(cycle) - 1 AS cycle, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS found, CAST(0 AS BIGINT) AS profitable, CAST(0 AS DOUBLE) AS roi, CAST(0 AS BIGINT) AS cycles FROM g GROUP BY category
 UNION ALL
 SELECT s.category, g.cycle, CAST(floor((s.total + coalesce(g.listings, 0)) * 9e-1) AS BIGINT), CAST(floor((s.found + coalesce(g.found, 0)) * 9e-1) AS BIGINT), CAST(floor((s.profitable + coalesce(g.profitable, 0)) * 9e-1) AS BIGINT),
  CASE WHEN coalesce(g.roi, 0) > 0 THEN CASE WHEN s.roi > 0 THEN s.roi * 7e-1 + g.roi * 3e-1 ELSE g.roi END ELSE s.roi END, s.cycles + CASE WHEN g.listings IS NULL THEN 0 ELSE 1 END
 FROM s JOIN g ON g.category = s.category AND g.cycle = s.cycle + 1),
y AS (SELECT *, {_SCORE} AS score FROM s WHERE EXISTS (SELECT 1 FROM g WHERE g.category = s.category AND g.cycle = s.cycle)),
z AS (SELECT *, max(score) OVER (PARTITION BY cycle) AS best FROM y)
SELECT {_OUT} FROM z"""


@query("q_category_cycles", _SQL)
def q_category_cycles(spark, sf_dir):
    """Counters and averages of each category after every month, decayed month by month, with the score and the pages of the next."""
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    of_month = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("cycle", F.expr(_MONTH)).groupBy(F.col("p_type").alias("category"), "cycle").agg(*[F.expr(c) for c in split(_COUNTS)])
    scored = category_cycles(of_month).withColumn("score", F.expr(_SCORE))
    # The best score of a cycle is an aggregate, one row per task and cycle.
    best = scored.groupBy("cycle").agg(F.max("score").alias("best"))
    return scored.join(best, "cycle").selectExpr(*split(_OUT))


# Suppliers' nations as keys: what came back is a failure, what earned less than its tax a false positive.
_MEAN = "cast(sum(cast(floor({} * {} + 5e-1) AS bigint)) AS double) / count(*) / {}"
_FALSE = "count(CASE WHEN l_discount < l_tax THEN 1 END) / cast(count(*) AS double)"
_FEEDBACK = (
    f"count(*) AS samples, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) / cast(count(*) AS double) AS success_rate, {_FALSE} AS false_rate, {_MEAN.format('l_discount', 1000, 1000)} AS buffer,"
    f" {_MEAN.format('l_tax', 1000, 10000)} AS decay, ({_FALSE} - 4e-1) * 1e-1 AS delta, {_MEAN.format('(l_discount - l_tax)', 1000, 1)} AS drift"
)
_NAMES = list(PARAMETERS)
_TARGETS = {"profit_buffer_pct": "buffer", "decay_rate_per_hour": "decay", "confidence_threshold": "confidence_threshold + delta", "min_roi": "min_roi + CASE WHEN drift < -5 THEN 1e-2 WHEN drift > 5 THEN -5e-3 ELSE 0e0 END", "min_profit_usd": "min_profit_usd + CASE WHEN drift < -10 THEN 2e0 WHEN drift > 10 THEN -1e0 ELSE 0e0 END"}


def _moved(name: str) -> str:
    _, least, most = PARAMETERS[name]
    return f"floor(least({most}e0, greatest({least}e0, {name} + greatest(-greatest(abs({name}) * 5e-2, 1e-3), least(greatest(abs({name}) * 5e-2, 1e-3), new_{name} - {name})))) * 1e6 + 5e-1) / 1e6"


_SEEN = "key, cycle, " + ", ".join(_NAMES) + ", frozen, version, outcome"
_CALIBRATION_SQL = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT s_nationkey AS key, {_MONTH} AS cycle, {_FEEDBACK} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate IS NOT NULL GROUP BY ALL),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cycle) AS step FROM f),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS cycle, CAST(0 AS BIGINT) AS step, {", ".join(f"CAST({PARAMETERS[n][0]} AS DOUBLE) AS {n}" for n in _NAMES)}, {", ".join(f"CAST({PARAMETERS[n][0]} AS DOUBLE) AS avg_{n}" for n in _NAMES)}, FALSE AS frozen, CAST(0 AS BIGINT) AS version, CAST('' AS VARCHAR) AS outcome FROM s
 UNION ALL
 SELECT key, cycle, step, {", ".join(f"CASE WHEN told = 'applied' THEN {_moved(n)} ELSE {n} END" for n in _NAMES)}, {", ".join(f"CASE WHEN told = 'applied' THEN new_{n} ELSE avg_{n} END" for n in _NAMES)},
  CASE WHEN told = 'samples' THEN frozen ELSE told <> 'applied' END, version + CASE WHEN told = 'applied' THEN 1 ELSE 0 END, told
 FROM (SELECT s.key, s.cycle, s.step, {", ".join(_NAMES)}, {", ".join(f"avg_{n}" for n in _NAMES)}, frozen, version, CASE WHEN samples < 10 THEN 'samples' WHEN success_rate < 5e-1 THEN 'success_rate' WHEN false_rate > 5e-1 THEN 'false_positive_rate' ELSE 'applied' END AS told,
   {", ".join(f"3e-1 * ({_TARGETS[n]}) + 7e-1 * avg_{n} AS new_{n}" for n in _NAMES)} FROM r JOIN s ON s.key = r.key AND s.step = r.step + 1))
SELECT {_SEEN} FROM r WHERE step > 0"""


@query("q_calibration_cycles", _CALIBRATION_SQL)
def q_calibration_cycles(spark, sf_dir):
    """Five parameters of each nation's suppliers after every month: smoothed, bounded in step and range, frozen while results are poor."""
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate is not null").join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    feedback = lines.withColumn("cycle", F.expr(_MONTH)).groupBy(F.col("s_nationkey").alias("key"), "cycle").agg(*[F.expr(c) for c in split(_FEEDBACK)])
    return calibrated(feedback).selectExpr(*split(_SEEN))
