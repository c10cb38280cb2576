"""Queries over fetched pages and the crawl: blocks, result cards, sub-categories, task lists, progress logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pages as pg
from tidemark.plans.define import query
from tidemark.sources.tables import load

_STATUS = "CASE page_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END"
_BODY = "CASE page_id % 9 WHEN 4 THEN concat('<div class=\"G-reCAPTCHA\">', html) WHEN 5 THEN concat('Access  Denied', html) WHEN 6 THEN substring(html, 1, 900) ELSE html END"


@query("q_block_detect", f"SELECT page_id, status, {pg.blocked_sql('status', 'body', lambda t, p: f"regexp_matches({t}, '{p}')")} AS kind FROM (SELECT page_id, {_STATUS} AS status, coalesce({_BODY}, '') AS body FROM pages)")
def q_block_detect(spark, sf_dir):
    """Responses that are blocks by status, by size, or by signs in their first 5,000 characters."""
    responses = load(spark, sf_dir, "pages").selectExpr("page_id", f"{_STATUS} AS status", f"coalesce({_BODY}, '') AS body")
    return responses.selectExpr("page_id", "status", f"{pg.blocked_sql('status', 'body', lambda t, p: f"{t} RLIKE '{p}'")} AS kind")


#: One written result page per marketplace, for tests.
RESULT_PAGES = {
    "ebay": '<ul><li class="s-item s-item__pl"><div class="s-item__title">Shop on eBay</div><a class="s-item__link" href="https://e.example/itm/0">x</a><span class="s-item__price">$20.00</span></div></li>'
    '<li class="s-item s-item__pl"><a class="s-item__link" href="https://e.example/itm/101?x=1"><div class="s-item__title"><span>Sony WH-1000XM4</span></div></a><span class="SECONDARY_INFO">Pre-Owned</span><div><span class="s-item__price"><span class="ITALIC">$1,199.50</span> to $1,249.00</span></div><span class="s-item__shipping">Free shipping</span><span class="s-item__seller-info-text">seller (120) 98.5%</span></li>'
    '<li class="s-item s-item__pl"><a class="s-item__link" href="https://e.example/itm/102"><h3 class="s-item__title">Bose QC45</h3></a><div><span class="s-item__price">£89.99</span></div><span class="s-item__shipping">+$5.00 shipping</span></li>'
    '<li class="s-item s-item__pl"><a class="s-item__link" href="https://e.example/other/9"><h3 class="s-item__title">No item</h3></a><div><span class="s-item__price">$9</span></div></li></ul><a class="pagination__next" href="https://e.example/sch?_pgn=2">next</a>',
    "mercadolibre_mx": '<ol><li class="ui-search-layout__item"><a class="ui-search-link" href="https://m.example/MLM-1"><h2 class="ui-search-item__title">Audífonos Sony</h2></a><span class="andes-money-amount__fraction">4.599</span><span class="andes-money-amount__cents">90</span><span class="ui-search-reviews__amount">(1,204)</span><div class="seller-status--excellent"></div><p>Envío gratis</p></li>'
    '<li class="ui-search-layout__item"><a class="ui-search-link" href="https://m.example/MLM-2"><h2 class="ui-search-item__title">Consola</h2></a><span class="price__fraction">999</span><span>Usado</span></li>'
    '<li class="ui-search-layout__item"><a class="ui-search-link" href="https://m.example/MLM-3"><h2 class="ui-search-item__title">Sin precio</h2></a></li></ol><a class="andes-pagination__link" title="Siguiente" href="https://m.example/_Desde_49">Siguiente</a>',
    "amazon_us": '<div data-component-type="s-search-result" data-asin="B01"><h2><a class="a-link" href="/Sony/dp/B01"><span class="a-text-normal">Sony XM5</span></a></h2><span class="a-offscreen">$1,348.00</span><span aria-label="4.6 out of 5 stars"></span><span class="a-size-base s-underline-text">12,345</span><span>FREE delivery</span></div>'
    '<div data-component-type="s-search-result" data-asin="B02"><h2><span class="a-text-normal">Anker cable</span></h2><span class="a-price-whole">12</span><span class="a-price-fraction">49</span></div>'
    '<div data-component-type="s-search-result" data-asin=""><span class="a-text-normal">No id</span><span class="a-offscreen">$1.00</span></div>'
    '<div data-component-type="s-search-result" data-asin="B04"><div data-component-type="sp-sponsored-result"></div><span class="a-text-normal">Advert</span><span class="a-offscreen">$1.00</span></div><a class="s-pagination-item s-pagination-next" href="/s?page=2">Next</a>',
}
_PAGES = ", ".join(f"('{mp}', '{html}')" for mp, html in RESULT_PAGES.items())


def cards(found: DataFrame, marketplace: str) -> DataFrame:
    """Rows of html, each exploded into its valid result cards; the marketplace chooses the parser."""
    at = lambda name: F.expr(pg.field(marketplace, name, ""))
    pieces = found.select(F.explode(F.slice(F.split("html", pg.CARDS[marketplace].opening), 2, 1 << 30)).alias("card"))
    rows = pieces.select(F.lit(marketplace).alias("mp"), "card", *[at(n).alias(n) for n in pg.FIELDS])
    return rows.where("url <> '' AND title <> '' AND price > 0").where(~at("skip")).drop("card")


def _cards_sql(mp: str) -> str:
    at = lambda name: pg.field(mp, name, ", 'g'")
    fields = ", ".join(f"{at(n)} AS {n}" for n in pg.FIELDS)
    return f"SELECT * EXCLUDE (card) FROM (SELECT '{mp}' AS mp, card, {fields} FROM (SELECT unnest(string_split(html, '{pg.CARDS[mp].opening}')[2:]) AS card FROM pages_of WHERE mp = '{mp}')) WHERE url <> '' AND title <> '' AND price > 0 AND NOT ({at('skip')})"


# A result page per order, in the markup of a marketplace; its lines are the cards, and it has a next page where there are four or more.
_WHOLE = "cast(floor(l_extendedprice / l_quantity) AS bigint)"
_CENTS = "lpad(cast(cast(floor(l_extendedprice / l_quantity * 100) AS bigint) % 100 AS {text}), 2, '0')"


def _thousands(sep: str) -> str:
    """A whole price as text, with a mark after the thousands."""
    return f"CASE WHEN {_WHOLE} >= 1000 THEN concat(cast(cast(floor({_WHOLE} / 1000) AS bigint) AS {{text}}), '{sep}', lpad(cast({_WHOLE} % 1000 AS {{text}}), 3, '0')) ELSE cast({_WHOLE} AS {{text}}) END"


_ID = "cast(l_orderkey * 10 + l_linenumber AS {text})"
_CARD = {
    "ebay": f"""concat('<li class="s-item s-item__pl"><a class="s-item__link" href="https://e.example/', CASE WHEN l_tax = 0 THEN 'other/' ELSE 'itm/' END, {_ID}, '?x=1"><div class="s-item__title"><span>', p_name, '</span></div></a>',
 CASE WHEN l_returnflag = 'R' THEN '<span class="SECONDARY_INFO">Pre-Owned</span>' ELSE '' END, '<div><span class="s-item__price">$', {_thousands(",")}, '.', {_CENTS}, CASE WHEN l_linenumber = 2 THEN ' to $9,999.00' ELSE '' END, '</span></div><span class="s-item__shipping">',
 CASE WHEN l_linestatus = 'F' THEN 'Free shipping' ELSE '+$5.00 shipping' END, '</span><span class="s-item__seller-info-text">seller (', cast(l_suppkey AS {{text}}), ') 98.5%</span></li>')""",
    "mercadolibre_mx": f"""concat('<li class="ui-search-layout__item"><a class="ui-search-link" href="https://m.example/MLM-', {_ID}, '"><h2 class="ui-search-item__title">', p_name, '</h2></a>', CASE WHEN l_tax = 0 THEN '' ELSE concat('<span class="andes-money-amount__fraction">', {_thousands(".")},
 '</span><span class="andes-money-amount__cents">', {_CENTS}, '</span>') END, '<span class="ui-search-reviews__amount">(', cast(l_suppkey AS {{text}}), ')</span>', CASE WHEN l_linestatus = 'F' THEN '<p>Envío gratis</p>' ELSE '' END, CASE WHEN l_returnflag = 'R' THEN '<span>Usado</span>' ELSE '' END, '</li>')""",
    "amazon_us": f"""concat('<div data-component-type="s-search-result" data-asin="', CASE WHEN l_tax = 0 THEN '' ELSE concat('B', {_ID}) END, '">', CASE WHEN l_linenumber = 3 THEN '<div data-component-type="sp-sponsored-result"></div>' ELSE '' END, '<h2><span class="a-text-normal">', p_name,
 '</span></h2><span class="a-offscreen">$', {_thousands(",")}, '.', {_CENTS}, '</span><span aria-label="4.6 out of 5 stars"></span><span class="a-size-base s-underline-text">', cast(l_suppkey AS {{text}}), '</span>', CASE WHEN l_linestatus = 'F' THEN '<span>FREE delivery</span>' ELSE '' END, '</div>')""",
}
_NEXT_LINK = {
    "ebay": '<a class="pagination__next" href="https://e.example/sch?_pgn=2">next</a>',
    "mercadolibre_mx": '<a class="andes-pagination__link" title="Siguiente" href="https://m.example/_Desde_49">Siguiente</a>',
    "amazon_us": '<a class="s-pagination-item s-pagination-next" href="/s?page=2">Next</a>',
}
_OF = "CASE o_orderstatus WHEN 'F' THEN 'ebay' WHEN 'O' THEN 'mercadolibre_mx' ELSE 'amazon_us' END"
_CARD_OF = "CASE mp " + " ".join(f"WHEN '{mp}' THEN {card}" for mp, card in _CARD.items()) + " END"
_LINK_OF = "CASE mp " + " ".join(f"WHEN '{mp}' THEN '{link}'" for mp, link in _NEXT_LINK.items()) + " END"
_PAGES_SQL = f"""cards AS (SELECT l_orderkey, mp, l_linenumber, l_partkey, l_suppkey, {_CARD_OF.format(text="VARCHAR")} AS card FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT o_orderkey, {_OF} AS mp FROM orders) ON l_orderkey = o_orderkey),
pages_of AS MATERIALIZED (SELECT l_orderkey AS page, mp, concat('<ul>', string_agg(card, '' ORDER BY l_linenumber, l_partkey, l_suppkey, card), '</ul>', CASE WHEN count(*) >= 4 THEN {_LINK_OF} ELSE '' END) AS html FROM cards GROUP BY l_orderkey, mp)"""


def result_pages(spark, sf_dir) -> DataFrame:
    """page, mp and html of each order's result page."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    orders = load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_OF} AS mp")
    made = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("card", F.expr(_CARD_OF.format(text="string")))
    found = made.groupBy(F.col("l_orderkey").alias("page"), "mp").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "card"))).alias("c"))
    body = F.concat(F.lit("<ul>"), F.array_join(F.transform("c", lambda x: x["card"]), ""), F.lit("</ul>"), F.when(F.size("c") >= 4, F.expr(_LINK_OF)).otherwise(F.lit("")))
    return found.select("page", "mp", body.alias("html"))


@query("q_result_cards", f"WITH {_PAGES_SQL} " + " UNION ALL ".join(_cards_sql(mp) for mp in pg.CARDS))
def q_result_cards(spark, sf_dir):
    """Listings from the result pages of three marketplaces; adverts and cards without link, title or price are dropped."""
    found = result_pages(spark, sf_dir)
    return reduce(DataFrame.unionByName, [cards(found.where(F.col("mp") == mp), mp) for mp in pg.CARDS])


_NEXT = lambda: "CASE mp " + " ".join(f"WHEN '{mp}' THEN {pg.field(mp, 'next_page', '')}" for mp in pg.CARDS) + " END"


@query("q_next_page", f"WITH {_PAGES_SQL} SELECT page, mp, nullif({_NEXT()}, '') AS next_page FROM pages_of")
def q_next_page(spark, sf_dir):
    """The link to the next page of each result page, null on the last."""
    return result_pages(spark, sf_dir).select("page", "mp", F.expr(f"nullif({_NEXT()}, '')").alias("next_page"))


_BAD = "|".join(pg.NO_CATEGORY)
_LINKS_SQL = "SELECT page_id, url, href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)"
_STEPS_SQL = _LINKS_SQL
for _name, _e in pg.LINK.items():
    _STEPS_SQL = f"SELECT *, {_e.replace('{g}', ", 'g'")} AS {_name} FROM ({_STEPS_SQL})"
_OWN = "regexp_replace(regexp_extract(url, '^([^?]*)', 1), '/+$', '')"
_VALID = f"target LIKE concat(host, '/%') AND path <> '' AND slug <> '' AND clean <> {_OWN}"


@query("q_subcategories", f"SELECT clean AS link, concat('discovered-', min(slug)) AS slug, min(page_id) AS page_id FROM ({_STEPS_SQL}) WHERE {_VALID} AND NOT regexp_matches(target, '(?i){_BAD}') GROUP BY clean")
def q_subcategories(spark, sf_dir):
    """Links inside the own host that may lead to sub-categories, each once with its slug and the first page that has it."""
    links = load(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    for name, e in pg.LINK.items():
        links = links.withColumn(name, F.expr(e.replace("{g}", "")))
    kept = links.where(_VALID).where(~F.col("target").rlike(f"(?i){_BAD}"))
    return kept.groupBy(F.col("clean").alias("link")).agg(F.concat(F.lit("discovered-"), F.min("slug")).alias("slug"), F.min("page_id").alias("page_id"))


_MARKETS = ("amazon_us", "ebay", "mercadolibre_mx")
_BUDGET = 40


@query("q_crawl_tasks", f"""WITH c AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type)
SELECT category, mp, page FROM (SELECT category, n, unnest(generate_series(1, 1 + n % 3)) AS page, m.mp, m.ord FROM c, (VALUES {', '.join(f"('{m}', {i})" for i, m in enumerate(_MARKETS))}) m(mp, ord))
ORDER BY n DESC, category, ord, page LIMIT {_BUDGET}""")
def q_crawl_tasks(spark, sf_dir):
    """Tasks by category, marketplace and page in order of priority until the budget is used; both lists are literals, so rows only explode."""
    c = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
    by_mp = c.select("category", "n", F.posexplode(F.array(*[F.lit(m) for m in _MARKETS])).alias("ord", "mp"))
    tasks = by_mp.select("category", "n", "ord", "mp", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("n") % 3)).alias("page"))
    return tasks.orderBy(F.desc("n"), "category", "ord", "page").limit(_BUDGET).select("category", "mp", "page")


#: Events as lines of a crawler's log; chr(39) is a quote.
_LINE = """CASE WHEN event_type = 'click' THEN concat({ts}, ' INFO Crawling ', chr(39), 'cat-', user_id % 20, chr(39), ' on ', event_type) WHEN event_type = 'error' THEN concat('Traceback: ', props)
ELSE concat({ts}, ' INFO [', event_type, '] ', chr(39), 'cat-', user_id % 20, chr(39), ': ', event_id % 50, ' scraped, ', event_id % 30, ' unique, ', event_id % 20, ' dupes, ', event_id % 10, ' published') END"""
_DONE = r"\[(\w+)\] '([\w-]+)': (\d+) scraped, (\d+) unique, (\d+) dupes, (\d+) published"
_NOW = r"Crawling '([\w-]+)' on (\w+)"
_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
_QUOTED = lambda p: p.replace("'", "''")

@query("q_crawl_progress", f"""WITH l AS (SELECT {_LINE.format(ts="strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS line FROM events),
p AS (SELECT regexp_extract(line, '{_TIME}', 1) AS told_at, regexp_extract(line, '{_QUOTED(_DONE)}', 1) AS mp, regexp_extract(line, '{_QUOTED(_DONE)}', 2) AS cat, TRY_CAST(regexp_extract(line, '{_QUOTED(_DONE)}', 3) AS BIGINT) AS scraped, TRY_CAST(regexp_extract(line, '{_QUOTED(_DONE)}', 5) AS BIGINT) AS dupes,
TRY_CAST(regexp_extract(line, '{_QUOTED(_DONE)}', 6) AS BIGINT) AS published, regexp_extract(line, '{_QUOTED(_NOW)}', 1) AS now_cat, regexp_extract(line, '{_QUOTED(_NOW)}', 2) AS now_mp FROM l)
SELECT count(DISTINCT CASE WHEN mp <> '' THEN concat(cat, '@', mp) END) AS completed, CAST(sum(scraped) AS BIGINT) AS scraped, CAST(sum(dupes) AS BIGINT) AS dupes, CAST(sum(published) AS BIGINT) AS published, min(nullif(told_at, '')) AS started_at, max(nullif(told_at, '')) AS last_at,
substr(max(CASE WHEN now_cat <> '' THEN concat(told_at, ' ', now_cat, ' @ ', now_mp) END), 21) AS current FROM p""")
def q_crawl_progress(spark, sf_dir):
    """Totals of a crawler's log by its lines: finished pairs, rows, first and last moment, and what the latest line crawls."""
    lines = load(spark, sf_dir, "events").select(F.expr(_LINE.format(ts="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")).alias("line"))
    done = lambda i: F.regexp_extract("line", _DONE, i)
    at, now = F.regexp_extract("line", _TIME, 1), lambda i: F.regexp_extract("line", _NOW, i)
    p = lines.select(at.alias("told_at"), done(1).alias("mp"), done(2).alias("cat"), *[done(i).try_cast("bigint").alias(n) for i, n in ((3, "scraped"), (5, "dupes"), (6, "published"))], now(1).alias("now_cat"), now(2).alias("now_mp"))
    told = F.nullif("told_at", F.lit(""))
    current = F.max(F.when(F.col("now_cat") != "", F.concat("told_at", F.lit(" "), "now_cat", F.lit(" @ "), "now_mp")))
    return p.agg(
        F.countDistinct(F.when(F.col("mp") != "", F.concat("cat", F.lit("@"), "mp"))).alias("completed"), F.sum("scraped").alias("scraped"), F.sum("dupes").alias("dupes"), F.sum("published").alias("published"),
        F.min(told).alias("started_at"), F.max(told).alias("last_at"), F.substring(current, 21, 200).alias("current"),
    )
