"""Queries about what to fetch next and how fast: search terms, the tasks of a cycle, request rates, items in nested JSON."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import keywords as kw
from tidemark.functions import pages as pg
from tidemark.plans.define import query
from tidemark.sources.tables import load

# Parts stand for search terms; the number of a part chooses its words.
_WORDS = ("USB Hub", "funda iphone", "sony", "samsung galaxy", "Cargador usb-c", "laptop lenovo", "JBL", "teclado gamer", "drone dji mini")
_TERM = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " WHEN 9 THEN concat('memoria ', p_name) ELSE p_name END"


@query("q_keyword_expansion", f"WITH terms AS (SELECT DISTINCT lower(trim({_TERM})) AS low FROM part), {kw.expansion_sql('terms')} SELECT low AS term, variant, place FROM expansion")
def q_keyword_expansion(spark, sf_dir):
    """Each search term and at most eight variants, in a fixed order."""
    terms = load(spark, sf_dir, "part").select(F.expr(f"lower(trim({_TERM}))").alias("term")).distinct()
    return terms.select("term", F.posexplode(kw.expanded(F.col("term"))).alias("i", "variant")).select("term", "variant", (F.col("i") + 1).cast("long").alias("place"))


@query("q_keyword_set", f"WITH terms AS (SELECT DISTINCT lower(trim({_TERM})) AS low FROM part), {kw.expansion_sql('terms', 6)} SELECT variant, count(*) AS terms FROM expansion GROUP BY variant")
def q_keyword_set(spark, sf_dir):
    """The distinct variants of all terms, six each, and of how many terms they are variants."""
    terms = load(spark, sf_dir, "part").select(F.expr(f"lower(trim({_TERM}))").alias("term")).distinct()
    return terms.select(F.explode(kw.expanded(F.col("term"), 6)).alias("variant")).groupBy("variant").agg(F.count("*").alias("terms"))


# Tasks of a cycle and the shares of its kinds; the last kind takes the rest.
CYCLE, SHARES = 500, {"category": 0.60, "search": 0.25, "trending": 0.15}
_BUDGETS = {kind: int(CYCLE * share) for kind, share in SHARES.items()}
_BUDGETS["trending"] = CYCLE - _BUDGETS["category"] - _BUDGETS["search"]
_KIND = "CASE page_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'trending' ELSE 'category' END"
_SHUFFLED = "md5(concat('cycle-1:', cast(page_id AS {text})))"


@query("q_cycle_split", f"""WITH t AS (SELECT page_id, {_KIND} AS kind, page_id % 4 AS priority, {_SHUFFLED.format(text='VARCHAR')} AS shuffled FROM pages),
c AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind ORDER BY page_id) <= CASE kind {' '.join(f"WHEN '{k}' THEN {n}" for k, n in _BUDGETS.items())} END)
SELECT page_id, kind, priority, row_number() OVER (ORDER BY priority, shuffled, page_id) AS place FROM c""")
def q_cycle_split(spark, sf_dir):
    """The tasks of one cycle: the budget of each kind, shuffled by a seed, in order of priority. A top-k report of 500 rows."""
    tasks = load(spark, sf_dir, "pages").selectExpr("page_id", f"{_KIND} AS kind", "page_id % 4 AS priority", f"{_SHUFFLED.format(text='string')} AS shuffled")
    chosen = reduce(lambda a, b: a.unionAll(b), [tasks.where(F.col("kind") == kind).orderBy("page_id").limit(n) for kind, n in _BUDGETS.items()])
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("priority", "shuffled", "page_id"))).drop("shuffled")


# Requests a second at first, at least and at most; what a window of many blocks and one of few multiply them with.
RATE, MIN_RATE, MAX_RATE, BACKOFF, RECOVERY = 2.0, 0.1, 10.0, 0.5, 1.1
MANY_BLOCKS, FEW_BLOCKS, LEAST_REQUESTS = 0.3, 0.05, 20
_BLOCKED = "CASE {day} % 4 WHEN 0 THEN event_type IN ('error', 'click') WHEN 1 THEN event_type = 'error' ELSE event_type = 'error' AND value > 1000 END"
_FACTOR = f"CASE WHEN blocks * 1e0 / requests > 3e-1 THEN 5e-1 WHEN blocks * 1e0 / requests < 5e-2 AND requests > {LEAST_REQUESTS} THEN 11e-1 ELSE 1e0 END"


def adapted(windows):
    """windows(mp, day, requests, blocks) with the rate after each: a fold along the days of a marketplace.

    Its rows are aggregates, one per marketplace and window, so a group grows with time and not with requests.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        steps = accumulate(rows["factor"], lambda rate, factor: min(MAX_RATE, max(MIN_RATE, rate * factor)), initial=RATE)
        return rows.assign(rate=list(steps)[1:])

    return windows.withColumn("factor", F.expr(_FACTOR)).groupBy("mp").applyInPandas(fold, "mp long, day long, requests long, blocks long, factor double, rate double")


@query("q_adaptive_rate", f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, {_FACTOR} AS factor, row_number() OVER (PARTITION BY mp ORDER BY day) AS i FROM
 (SELECT mp, day, count(*) AS requests, count(CASE WHEN {_BLOCKED.format(day='day')} THEN 1 END) AS blocks FROM (SELECT user_id % 5 AS mp, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, value FROM events) GROUP BY mp, day)),
f AS (SELECT mp, i, least(10e0, greatest(1e-1, 2e0 * factor)) AS rate FROM w WHERE i = 1 UNION ALL SELECT w.mp, w.i, least(10e0, greatest(1e-1, f.rate * factor)) FROM f JOIN w ON w.mp = f.mp AND w.i = f.i + 1)
SELECT mp, day, requests, blocks, floor(rate * 1e6 + 0.5) / 1e6 AS rate FROM w JOIN f USING (mp, i)""")
def q_adaptive_rate(spark, sf_dir):
    """The request rate of each marketplace after each day's share of blocked requests."""
    requests = load(spark, sf_dir, "events").selectExpr("user_id % 5 AS mp", "cast(floor(unix_micros(cast(ts AS timestamp)) / 86400e6) AS long) AS day", "event_type", "value")
    windows = requests.groupBy("mp", "day").agg(F.count("*").alias("requests"), F.expr(f"count(CASE WHEN {_BLOCKED.format(day='day')} THEN 1 END)").alias("blocks"))
    return adapted(windows).selectExpr("mp", "day", "requests", "blocks", "floor(rate * 1e6 + 0.5) / 1e6 AS rate")


@query("q_nested_items", """SELECT l_orderkey AS page, concat('L', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS item, l_quantity AS price FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, concat(k, CAST(l_orderkey AS VARCHAR)), NULL FROM lineitem, (VALUES ('P'), ('Q')) t(k)""")
def q_nested_items(spark, sf_dir):
    """Items at any depth of the JSON of a page, built here of each order: its lines in a list, whose inner items do not
    count; an item in an object, whose inner item counts; and a list in a list, which is not searched."""
    line = load(spark, sf_dir, "lineitem")
    inner = F.struct(F.lit("hidden").alias("productId"))
    item = F.struct(F.expr("concat('L', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))").alias("itemId"), F.col("l_quantity").alias("price"), inner.alias("sub"))
    key = F.col("l_orderkey").cast("string")
    pages = line.groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select(
        F.col("l_orderkey").alias("page"),
        F.to_json(F.struct(
            F.struct(F.struct("items").alias("mods")).alias("data"),
            F.struct(F.concat(F.lit("P"), key).alias("productId"), F.struct(F.concat(F.lit("Q"), key).alias("itemId")).alias("next")).alias("main"),
            F.array(F.array(inner)).alias("grid"),
        )).alias("json"),
    )
    found = pages.select("page", F.explode(pg.find_items("json")).alias("found"))
    of = lambda path: F.nullif(F.get_json_object("found", f"$.{path}"), F.lit(""))
    return found.select("page", F.coalesce(of("productId"), of("itemId")).alias("item"), of("price").cast("double").alias("price"))
