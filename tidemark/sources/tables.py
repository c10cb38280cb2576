"""Input tables, and the marketplace datasets derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Moment that stands for "now" in every rule about age.
AS_OF = "2001-11-05"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Marketplaces with fees; fixed payment fee in local currency.
FEES = (
    ("amazon", 0.15, 0.0, 0.0, 0.16, 0.0, "MXN", "MX"),
    ("amazon_us", 0.15, 0.0, 0.0, 0.0, 0.0, "USD", "US"),
    ("mercadolibre_mx", 0.16, 0.036, 5.0, 0.16, 0.0, "MXN", "MX"),
    ("mercadolibre_ar", 0.13, 0.036, 450.0, 0.21, 0.0, "ARS", "AR"),
    ("mercadolibre_cl", 0.13, 0.036, 250.0, 0.19, 0.0, "CLP", "CL"),
    ("ebay", 0.1312, 0.0, 0.0, 0.0, 8.0, "USD", "US"),
    ("aliexpress", 0.08, 0.0, 0.0, 0.0, 0.0, "USD", "CN"),
    ("mercadolibre_co", 0.14, 0.036, 1200.0, 0.19, 0.0, "COP", "CO"),
)
# Import tax, shipping in USD and insurance by buying and selling country.
CROSS_BORDER = (
    ("US", "MX", 0.16, 15.0, 0.02), ("US", "CL", 0.19, 22.0, 0.02), ("US", "AR", 0.50, 25.0, 0.02),
    ("MX", "CL", 0.19, 12.0, 0.02), ("MX", "AR", 0.50, 14.0, 0.02), ("MX", "US", 0.0, 15.0, 0.02),
    ("CN", "MX", 0.16, 8.0, 0.02), ("CN", "CL", 0.19, 12.0, 0.02), ("CN", "AR", 0.50, 15.0, 0.02), ("CN", "US", 0.0, 10.0, 0.02),
    ("AR", "MX", 0.16, 45.0, 0.02), ("AR", "US", 0.0, 50.0, 0.02), ("CL", "MX", 0.16, 18.0, 0.02), ("CL", "US", 0.0, 25.0, 0.02),
    ("US", "CO", 0.19, 22.0, 0.02), ("MX", "CO", 0.19, 15.0, 0.02), ("CN", "CO", 0.19, 14.0, 0.02), ("CO", "MX", 0.16, 15.0, 0.02), ("CO", "US", 0.0, 22.0, 0.02),
)
#: For pairs of countries that are not listed.
DEFAULT_BORDER = (0.20, 40.0, 0.02)
# Valid routes with label and difficulty.
ROUTES = (
    ("amazon_us", "mercadolibre_mx", "US→MX", 1), ("amazon_us", "mercadolibre_cl", "US→CL", 2), ("amazon_us", "mercadolibre_ar", "US→AR", 3),
    ("ebay", "mercadolibre_mx", "US→MX", 1), ("ebay", "mercadolibre_cl", "US→CL", 2), ("ebay", "mercadolibre_ar", "US→AR", 3),
    ("amazon", "mercadolibre_mx", "MX→MX", 1), ("mercadolibre_mx", "amazon", "MX→MX", 1), ("amazon", "mercadolibre_cl", "MX→CL", 2),
    ("amazon", "mercadolibre_ar", "MX→AR", 3), ("mercadolibre_mx", "mercadolibre_cl", "MX→CL", 2), ("mercadolibre_mx", "mercadolibre_ar", "MX→AR", 3),
    ("aliexpress", "mercadolibre_mx", "CN→MX", 2), ("aliexpress", "mercadolibre_cl", "CN→CL", 2), ("aliexpress", "mercadolibre_ar", "CN→AR", 3),
    ("aliexpress", "amazon", "CN→MX", 2), ("amazon_us", "mercadolibre_co", "US→CO", 2), ("ebay", "mercadolibre_co", "US→CO", 2),
    ("aliexpress", "mercadolibre_co", "CN→CO", 2), ("amazon", "mercadolibre_co", "MX→CO", 2), ("mercadolibre_ar", "mercadolibre_mx", "AR→MX", 2),
    ("mercadolibre_cl", "mercadolibre_mx", "CL→MX", 2), ("mercadolibre_co", "mercadolibre_mx", "CO→MX", 2),
)
# Units per USD when no live rate is known.
FX = (("USD", 1.0), ("ARS", 1050.0), ("MXN", 17.8), ("EUR", 0.86), ("GBP", 0.75), ("BRL", 5.10), ("CLP", 950.0), ("COP", 4100.0), ("CNY", 7.25))
# Least and most plausible price by currency.
PRICE_BOUNDS = (
    ("ARS", 500.0, 50e6), ("MXN", 10.0, 500e3), ("USD", 0.5, 50e3), ("EUR", 0.5, 50e3), ("GBP", 0.5, 50e3),
    ("BRL", 2.0, 300e3), ("CLP", 500.0, 50e6), ("COP", 1000.0, 200e6), ("CNY", 1.0, 350e3),
)

#: Name to (columns, rows) of the small dimensions; all are literals of this module, so their size is fixed.
DIMENSIONS = {
    "fees": ("mp string, commission double, pay_pct double, pay_fixed double, vat double, dom_ship double, currency string, country string", FEES),
    "cross_border": ("buy_country string, sell_country string, tax double, ship double, insurance double", CROSS_BORDER),
    "routes": ("buy_mp string, sell_mp string, label string, difficulty int", ROUTES),
    "fx": ("currency string, rate double", FX),
    "price_bounds": ("currency string, least double, most double", PRICE_BOUNDS),
}


def _values(name: str) -> tuple[str, str]:
    """Rows and column names of a dimension as SQL literals."""
    schema, rows = DIMENSIONS[name]
    kinds = [c.split() for c in schema.split(", ")]
    cell = lambda v, k: f"'{v}'" if k == "string" else f"CAST({v!r} AS {k})"
    return ", ".join("(" + ", ".join(cell(v, k) for v, (_, k) in zip(row, kinds)) + ")" for row in rows), ", ".join(n for n, _ in kinds)


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """A small literal table; its size is known to the planner, which broadcasts it."""
    values, names = _values(name)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def dimension_sql(name: str) -> str:
    """The same dimension as a CTE of literals."""
    values, names = _values(name)
    return f"{name}({names}) AS (VALUES {values})"


#: The five regions stand for five marketplaces.
MARKETPLACE = "CASE r_name WHEN 'AFRICA' THEN 'amazon_us' WHEN 'AMERICA' THEN 'amazon' WHEN 'ASIA' THEN 'aliexpress' WHEN 'EUROPE' THEN 'mercadolibre_mx' ELSE 'mercadolibre_cl' END"
#: Columns of a listing, from the latest line of a part and supplier.
LISTING = {
    "product_id": "l_partkey",
    "seller_id": "l_suppkey",
    "url": "concat(cast(l_partkey AS {text}), '-', cast(l_suppkey AS {text}))",
    "mp": MARKETPLACE,
    "title": "p_name",
    "condition": "CASE WHEN l_returnflag = 'R' THEN 'used' ELSE 'new' END",
    "rating": "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE floor(least(5.0, greatest(0.0, (s_acctbal + 3000) / 2400)) * 10 + 0.5) / 10 END",
    "reviews": "cast(l_orderkey % 120 AS bigint)",
    "sales": "cast(l_linenumber * (l_orderkey % 9) AS bigint)",
    "free_ship": "l_linestatus = 'F'",
    "scraped_at": "l_shipdate",
    "unit_usd": "l_extendedprice / l_quantity",
}


def listings(spark: SparkSession, sf_dir: str, facts: bool = False) -> DataFrame:
    """One row per (part, supplier): its latest line, as a listing with a price in local currency and in USD.

    The latest line is a ranked window, whose limit of one row per pair also holds before the shuffle. With ``facts``
    the same pass, then over all lines, also gives the listing's history: first_at, age_days (one at least),
    and n_prices, price_avg, price_dev of its latest 20 prices.
    """
    line = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    of_listing = Window.partitionBy("l_partkey", "l_suppkey")
    line = line.withColumn("rn", F.row_number().over(of_listing.orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))))
    if facts:
        price = F.when(F.col("rn") <= 20, F.col("l_extendedprice") / F.col("l_quantity"))
        told = {"first_at": F.min("l_shipdate"), "n_prices": F.count(price), "price_avg": F.avg(price), "price_dev": F.stddev_samp(price)}
        line = line.withColumns({name: e.over(of_listing) for name, e in told.items()})
    latest = line.where("rn = 1").drop("rn")
    sellers = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_acctbal", "r_name")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = latest.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    history = {"first_at": "first_at", "age_days": f"greatest(1D, (unix_timestamp(timestamp_ntz '{AS_OF}') - unix_timestamp(first_at)) / 86400D)", "n_prices": "n_prices", "price_avg": "price_avg", "price_dev": "price_dev"} if facts else {}
    named = joined.select(*[F.expr(e.format(text="string")).alias(n) for n, e in (LISTING | history).items()])
    return named.join(dimension(spark, "fees").select("mp", "currency"), "mp").join(dimension(spark, "fx"), "currency").selectExpr(*LISTING, *history, "currency", "floor(unit_usd * rate * 100 + 0.5) / 100 AS price", "floor(unit_usd * rate * 100 + 0.5) / 100 / rate AS usd").drop("unit_usd")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an observed price: url, product_id, price_usd, recorded_at and seq, which breaks ties."""
    return load(spark, sf_dir, "lineitem").selectExpr("concat(cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS url", "l_partkey AS product_id", "l_suppkey AS seller_id", "l_extendedprice / l_quantity AS price_usd", "l_shipdate AS recorded_at", "l_orderkey * 10 + l_linenumber AS seq")


_SELECT = ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in LISTING.items())
#: The derived datasets as CTEs.
SQL = {
    "dims": ", ".join(dimension_sql(n) for n in DIMENSIONS),
    "listings": f"""latest AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1),
        named AS (SELECT {_SELECT} FROM latest JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
        listings AS MATERIALIZED (SELECT named.* EXCLUDE (unit_usd), fees.currency, floor(unit_usd * rate * 100 + 0.5) / 100 AS price, floor(unit_usd * rate * 100 + 0.5) / 100 / rate AS usd
                     FROM named JOIN fees USING (mp) JOIN fx ON fees.currency = fx.currency)""",
    "history": """history AS (SELECT concat(CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS url, l_partkey AS product_id, l_suppkey AS seller_id,
                  l_extendedprice / l_quantity AS price_usd, l_shipdate AS recorded_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)""",
}
