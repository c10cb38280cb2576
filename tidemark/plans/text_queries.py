"""Queries over titles and vectors: normalisation, brands, categories, hashes, price strings, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.functions import text as tx
from tidemark.plans.define import query, split
from tidemark.sources.tables import load

_r = fx.rounded
#: Accents as DuckDB's strip_accents() takes them off, for the Latin letters of the texts.
_PLAIN = "strip_accents(lower({}))"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TITLE_SQL = f"array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[^a-z0-9\\s-]', ' ', 'g'), '([a-z])-([0-9])', '\\1\\2', 'g'), '([0-9])-([a-z])', '\\1\\2', 'g'), '\\S+'), lambda x: len(x) > 1 AND x NOT IN ({_STOP})), ' ')"


@query("q_normalize_title", f"SELECT doc_id, {_TITLE_SQL.format('text')} AS title FROM documents WHERE text IS NOT NULL")
def q_normalize_title(spark, sf_dir):
    """Whole texts as normalised titles."""
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.normalize_title(F.col("text")).alias("title"))


_HASH = "substr(sha256(concat_ws('|', trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')), source, printf('%.2f', n_chars * 1.0))), 1, 16)"


@query("q_dedup_hash", f"SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {_HASH} AS hash FROM documents WHERE text IS NOT NULL) GROUP BY hash")
def q_dedup_hash(spark, sf_dir):
    """Listing hashes of title, marketplace and price; the least id of each is kept."""
    rows = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.listing_hash(F.col("text"), F.col("source"), F.col("n_chars")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_CASES = " ".join(f"WHEN regexp_matches(text, '{'|'.join(ps)}', 'i') THEN '{c}'" for c, ps in tx.CATEGORY_RULES)


@query("q_category_backfill", f"SELECT doc_id, CASE {_CASES} ELSE 'Other' END AS category FROM documents WHERE text IS NOT NULL")
def q_category_backfill(spark, sf_dir):
    """Ordered rules, the first match names the category."""
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.category(F.col("text")).alias("category"))


_BRANDS = ", ".join(f"'{b}'" for b in tx.BRANDS)
_TOKENS = "string_split(title, ' ')"


_KNOWN = " ".join(f"WHEN contains(title, '{name}') THEN '{known}'" for name, known in tx.KNOWN_MODELS)


@query("q_brand_model", f"""SELECT doc_id, brand, CASE {_KNOWN} ELSE list_filter({_TOKENS}, lambda x: regexp_full_match(x, '[a-z]*[0-9][a-z0-9]*') AND len(x) >= 3 AND x <> coalesce(brand, ''))[1] END AS model
FROM (SELECT *, list_filter({_TOKENS}, lambda x: x IN ({_BRANDS}))[1] AS brand FROM (SELECT doc_id, {_TITLE_SQL.format('text')} AS title FROM documents WHERE text IS NOT NULL))""")
def q_brand_model(spark, sf_dir):
    titles = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.normalize_title(F.col("text")).alias("title"))
    return titles.select("doc_id", tx.brand(F.col("title")).alias("brand"), tx.model(F.col("title")).alias("model"))


@query("q_product_type", f"""SELECT doc_id, CASE WHEN regexp_matches(title, '{"|".join(tx.TYPE_MAINS)}') THEN 'main' WHEN regexp_matches(title, '{"|".join(tx.TYPE_ACCESSORIES)}') THEN 'accessory' ELSE 'main' END AS kind
FROM (SELECT doc_id, {_TITLE_SQL.format('text')} AS title FROM documents WHERE text IS NOT NULL)""")
def q_product_type(spark, sf_dir):
    """Accessory or main product, where any word of a main product decides; q_accessory_flags goes by what comes first."""
    titles = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.normalize_title(F.col("text")).alias("title"))
    return titles.select("doc_id", tx.product_type(F.col("title")).alias("kind"))


#: Written price strings with their currency, for tests.
PRICES = (("$1,299.99", "USD"), ("405.188", "ARS"), ("193,70", "ARS"), ("$199.00 to $249.00", "USD"), ("", "USD"), ("1.234.567,89", "CLP"), ("12,345", "MXN"), ("12,345.67", "MXN"), ("abc", "USD"), ("7", "COP"))
# Lines' prices as their marketplaces write them: the number of the line chooses the format.
_PRICE_KIND = "CASE l_linenumber WHEN 1 THEN 'USD' WHEN 2 THEN 'ARS' WHEN 3 THEN 'USD' WHEN 4 THEN 'CLP' WHEN 5 THEN 'MXN' WHEN 6 THEN 'COP' ELSE 'USD' END"
_GROUPED = "CASE WHEN w >= 1000 THEN concat(cast(cast(floor(w / 1000) AS bigint) AS {text}), '{sep}', lpad(cast(w % 1000 AS {text}), 3, '0')) ELSE cast(w AS {text}) END"
_DOTS, _COMMAS, _TAIL = _GROUPED.replace("{sep}", "."), _GROUPED.replace("{sep}", ","), "lpad(cast(c AS {text}), 2, '0')"
_RAW = f"CASE l_linenumber WHEN 1 THEN concat('$', {_COMMAS}, '.', {_TAIL}) WHEN 2 THEN concat({_DOTS}, ',', {_TAIL}) WHEN 3 THEN concat('$', {_COMMAS}, '.', {_TAIL}, ' to $', {_COMMAS}, '.99') WHEN 4 THEN {_DOTS} WHEN 5 THEN concat('MXN ', {_COMMAS}) WHEN 6 THEN '' ELSE 'n/a' END"
_SPLIT = f"l_orderkey, l_linenumber, {_PRICE_KIND} AS currency, cast(floor(l_extendedprice) AS bigint) AS w, cast(floor(l_extendedprice * 100) AS bigint) % 100 AS c"
_NUMBER = "regexp_replace(regexp_replace(raw, ' to .*', ''), '[^0-9.,]', '', 'g')"


@query("q_price_parse", f"SELECT l_orderkey, l_linenumber, raw, currency, TRY_CAST(CASE WHEN currency IN ('ARS', 'CLP', 'COP') THEN replace(replace({_NUMBER}, '.', ''), ',', '.') ELSE replace({_NUMBER}, ',', '') END AS DOUBLE) AS price FROM (SELECT *, {_RAW.format(text='VARCHAR')} AS raw FROM (SELECT {_SPLIT} FROM lineitem))")
def q_price_parse(spark, sf_dir):
    """Local number formats: the first of a range, dots as thousands in three currencies, null where there is no number."""
    rows = load(spark, sf_dir, "lineitem").selectExpr(*split(_SPLIT)).withColumn("raw", F.expr(_RAW.format(text="string")))
    return rows.select("l_orderkey", "l_linenumber", "raw", "currency", tx.parse_price(F.col("raw"), F.col("currency")).alias("price"))


def nearest(spark, sf_dir: str, ask: str, answer: str):
    """The most similar other row among those that answer, within the block (label), for each row that asks."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    unit = e.withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))))
    products = unit.where(answer).select(F.col("vec_id").alias("product_id"), "label", F.col("v").alias("p"))
    asked = unit.where(ask).select("vec_id", "label", "v")
    dot = F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = asked.join(products, "label").where("vec_id <> product_id").select("vec_id", "product_id", (F.floor(dot * 1e5 + 0.5) / 1e5).alias("sim"))
    best = scored.groupBy("vec_id").agg(F.max_by(F.struct("product_id", "sim"), F.struct("sim", -F.col("product_id"))).alias("b"))
    return best.select("vec_id", "b.product_id", "b.sim", (F.col("b.sim") >= 0.75).alias("accepted"))


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


_BLOCKED_SQL = f"""WITH e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings),
s AS (SELECT q.vec_id, p.vec_id AS product_id, floor(list_cosine_similarity(q.v, p.v) * 1e5 + 0.5) / 1e5 AS sim FROM e q JOIN e p ON p.label = q.label AND p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT vec_id, product_id, sim, sim >= 0.75 AS accepted FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, product_id) = 1"""


@query("q_resolve_blocked", _BLOCKED_SQL)
@query("q_resolve_blocked_whole", _BLOCKED_SQL)
def q_resolve_blocked(spark, sf_dir):
    """The nearest other row of each query row within its block (label as brand); queries are every 100th id.

    The answering side is blocked by an equi-join and reduced per query by a partial aggregate.
    """
    return nearest(spark, sf_dir, "vec_id % 100 = 0", "true")


@query("q_title_match", """WITH t AS (SELECT p_partkey, p_brand, p_type, string_split(lower(p_name), ' ') AS w FROM part), j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_distinct(a.w) AS x, list_distinct(b.w) AS y FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND a.p_partkey % 100 = 0)
SELECT a, b, len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) >= 0.25 AS alike FROM j""")
def q_title_match(spark, sf_dir):
    """Token overlap of titles within brand and type; every hundredth part asks, all parts answer."""
    t = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    asks = t.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("a"), "p_brand", "p_type", F.col("w").alias("x"))
    both = asks.join(t.select(F.col("p_partkey").alias("b"), "p_brand", "p_type", F.col("w").alias("y")), ["p_brand", "p_type"]).where("a <> b")
    return both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= 0.25).alias("alike"))



@query("q_accessory_flags", f"""SELECT doc_id, {tx.accessory_sql('lower(text)')} AS accessory FROM documents WHERE text IS NOT NULL""")
def q_accessory_flags(spark, sf_dir):
    """An accessory word before the first word of a main product."""
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(tx.accessory_sql("lower(text)")).alias("accessory"))
