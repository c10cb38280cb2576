"""The cross-market opportunity scan as one set-based job: filters, statistics, pairs, fees, scores, choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import formulas as fx
from tidemark.functions import variants as va
from tidemark.sources.tables import AS_OF, DEFAULT_BORDER, dimension

MIN_PROFIT, MIN_MARGIN, MIN_ROI, MAX_ROI, MAX_RATIO = 20.0, 0.01, 0.15, 1.5, 8.0
MIN_RATING = 2.5
CLEAN_COLUMNS = ("product_id", "seller_id", "url", "mp", "title", "condition", "rating", "reviews", "sales", "free_ship", "scraped_at", "currency", "price", "usd")


def fresh(listings: DataFrame, days: int, as_of: str = AS_OF) -> DataFrame:
    """Listings seen in the last days before as_of."""
    return listings.where(F.col("scraped_at") > F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS"))


def trusted(listings: DataFrame, least: float = MIN_RATING) -> DataFrame:
    """Sellers without a rating are trusted."""
    return listings.where(F.col("rating").isNull() | (F.col("rating") >= least))


def plausible(listings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Prices within the bounds of their currency; the bounds are a literal dimension."""
    return listings.join(bounds, "currency").where("price BETWEEN least AND most").drop("least", "most")


def exclusive_quartile(p: float, i: str, n: str, value: str) -> Column:
    """The quartile by the exclusive method, to be summed over the values ranked i of n: position p (n + 1), interpolated."""
    pos = F.lit(p) * (F.col(n) + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(pos), F.col(n) - 1))
    return F.when(F.col(i) == j, F.col(value) * (1 - (pos - j))).when(F.col(i) == j + 1, F.col(value) * (pos - j)).otherwise(0.0)


def without_outliers(df: DataFrame, key: str = "product_id", value: str = "usd") -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their key; keys of fewer than four rows keep all.

    Ranks, counts and quartiles are windows over one partitioning by the key, which spill; no list per key is built.
    """
    of_key = Window.partitionBy(key)
    ranked = df.withColumn("_i", F.row_number().over(of_key.orderBy(value))).withColumn("_n", F.count("*").over(of_key))
    ranked = ranked.withColumns({f"_q{k}": F.sum(exclusive_quartile(k / 4, "_i", "_n", value)).over(of_key) for k in (1, 3)})
    iqr = F.col("_q3") - F.col("_q1")
    kept = (F.col("_n") < 4) | F.col(value).between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr)
    return ranked.where(kept).drop("_i", "_n", "_q1", "_q3")


def in_several_markets(df: DataFrame, least: int = 2) -> DataFrame:
    """product_id, marketplaces and listings of products on ``least`` marketplaces or more."""
    return df.groupBy("product_id").agg(F.countDistinct("mp").alias("n_mp"), F.count("*").alias("n_listings")).where(F.col("n_mp") >= least)


def first_seen(history: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Days since the first price of each url, one at least."""
    return history.groupBy("url").agg(F.min("recorded_at").alias("first_at")).selectExpr("url", "first_at", f"greatest(1D, (unix_timestamp(timestamp_ntz '{as_of}') - unix_timestamp(first_at)) / 86400D) AS age_days")


def stability(history: DataFrame, latest: int = 20) -> DataFrame:
    """Price stability of each url over its latest prices; the top-k filter prunes before the shuffle."""
    w = Window.partitionBy("url").orderBy(F.col("recorded_at").desc(), F.col("seq").desc())
    top = history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= latest)
    return top.groupBy("url").agg(F.count("*").alias("n_prices"), F.avg("price_usd").alias("price_avg"), F.stddev_samp("price_usd").alias("price_dev")).withColumn("stability", F.expr(fx.STABILITY))


def market_depth(listings: DataFrame) -> DataFrame:
    """Daily sales, depth score and level per product and marketplace, from the median of the estimates of its listings."""
    both = F.array(F.when(F.col("sales") > 0, F.col("sales") / F.col("age_days")), F.when(F.col("reviews") > 0, F.col("reviews") / 0.03 / F.greatest("age_days", F.lit(1.0))))
    per = listings.select("product_id", "mp", F.posexplode(both).alias("k", "estimate")).groupBy("product_id", "mp").agg(F.median("estimate").alias("mid"), F.count_if(F.col("k") == 0).alias("n"))
    daily = "CASE WHEN mid IS NULL THEN greatest(0.1, n / 3.0) ELSE mid * CASE WHEN n >= 10 THEN 1.5 WHEN n >= 5 THEN 1.2 ELSE 1.0 END END"
    out = per.selectExpr("product_id", "mp", f"{fx.rounded(daily, 2)} AS daily_sales", f"{fx.rounded('(' + daily + ') * 30', 1)} AS monthly_sales")
    return out.withColumn("depth_score", F.expr(fx.DEPTH_SCORE)).withColumn("scalability", F.expr("CASE WHEN depth_score >= 70 THEN 'high' WHEN depth_score >= 40 THEN 'medium' ELSE 'low' END"))


def marketplace_stats(listings: DataFrame) -> DataFrame:
    """Per product and marketplace: prices, the cheapest listing (ties by url), sums, velocity."""
    bought = [c for c in ("url", "condition", "rating", "reviews", "free_ship", "scraped_at", "variant_no") if c in listings.columns]
    stats = listings.groupBy("product_id", "mp").agg(
        F.count("*").alias("n"), F.min("usd").alias("min_usd"), F.avg("usd").alias("avg_usd"), F.max("usd").alias("max_usd"),
        F.sum("sales").alias("sales_sum"), F.sum("reviews").alias("reviews_sum"), F.avg(F.when(F.col("rating") > 0, F.col("rating"))).alias("rating_avg"),
        F.min_by(F.struct(*bought), F.struct("usd", "url")).alias("buy"),
        F.max("n_listings").alias("n_listings"),
    )
    return stats.withColumn("price_spread", F.when((F.col("n") > 1) & (F.col("avg_usd") > 0), (F.col("max_usd") - F.col("min_usd")) / F.col("avg_usd")).otherwise(0.0)).withColumn("velocity", F.expr(fx.VELOCITY))


def route_pairs(stats: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs of marketplaces of a product on a valid route whose selling side is above the cheapest buy."""
    buy = stats.select("product_id", F.col("mp").alias("buy_mp"), F.col("min_usd").alias("buy_usd"), F.col("buy.url").alias("buy_url"), F.col("buy.condition").alias("condition"), F.col("buy.rating").alias("buy_rating"), F.col("buy.reviews").alias("buy_reviews"), F.col("buy.free_ship").alias("buy_free"), F.col("buy.scraped_at").alias("buy_at"), *[F.col("buy.variant_no").alias("buy_variant")] * ("variant_no" in stats.schema["buy"].dataType.names))
    sell = stats.select("product_id", F.col("mp").alias("sell_mp"), "min_usd", "price_spread", "sales_sum", "reviews_sum", "velocity", "n_listings")
    return buy.join(routes, "buy_mp").join(sell, ["product_id", "sell_mp"]).where("min_usd > buy_usd")


def offers(listings: DataFrame) -> DataFrame:
    """What a buy meets on a marketplace: number, prices and dearest of the listings that fit it, per product, marketplace and variant bought."""
    named = {"sell_url": "url", "sell_rating": "rating", "sell_reviews": "reviews", "sell_free": "free_ship", "sell_at": "scraped_at", "stability": "stability", "age_days": "age_days"}
    top = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in named.items() if c in listings.columns]), F.struct("usd", "url"))
    out = listings.withColumn("buy_variant", F.explode("fits")).groupBy("product_id", F.col("mp").alias("sell_mp"), "buy_variant").agg(F.count("*").alias("n"), F.min("usd").alias("lowest_usd"), F.avg("usd").alias("mean_usd"), F.max("usd").alias("highest_usd"), F.median("usd").alias("median_usd"), top.alias("sell"))
    out = out.withColumn("spread", (F.col("highest_usd") - F.col("lowest_usd")) / F.col("mean_usd")).withColumn("competition_score", F.expr(fx.COMPETITION_SCORE)).withColumn("sell_usd", F.expr(fx.rounded(f"median_usd * {fx.REALISTIC_SHARE}", 2)))
    return out.select("product_id", "sell_mp", "buy_variant", "n", "lowest_usd", "mean_usd", "median_usd", "competition_score", "sell_usd", "sell.*")


def competition(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """Pairs with the sell-side competition among listings that fit the one bought, and the dearest of them."""
    return pairs.join(offers(listings), ["product_id", "sell_mp", "buy_variant"])


# Of a marketplace that has no fees listed.
DEFAULT_FEES = {"commission": 0.1312, "pay_pct": 0.0, "pay_fixed": 0.0, "vat": 0.0, "dom_ship": 8.0, "rate": 1.0, "sell_country": "?", "buy_country": "?"}


def with_fees(pairs: DataFrame, spark: SparkSession) -> DataFrame:
    """All costs of each pair: fees of the selling side, and of the border where countries differ; unknown marketplaces take the default."""
    fees = dimension(spark, "fees")
    sell = fees.withColumnRenamed("mp", "sell_mp").withColumnRenamed("country", "sell_country").join(dimension(spark, "fx"), "currency").drop("currency")
    buy = fees.select(F.col("mp").alias("buy_mp"), F.col("country").alias("buy_country"))
    tax, ship, insurance = DEFAULT_BORDER
    out = pairs.join(sell, "sell_mp", "left").join(buy, "buy_mp", "left").fillna(DEFAULT_FEES).join(dimension(spark, "cross_border"), ["buy_country", "sell_country"], "left")
    out = out.fillna({"tax": tax, "ship": ship, "insurance": insurance}).withColumn("cross_border", F.col("buy_country") != F.col("sell_country"))
    return out.withColumns({name: F.expr(e) for name, e in FEE_COLUMNS.items()}).withColumns({name: F.expr(e) for name, e in PROFIT_COLUMNS.items()})


FEE_COLUMNS = {"marketplace_fee": fx.MARKETPLACE_FEE, "payment_fee": fx.PAYMENT_FEE, "sell_tax": fx.SELL_TAX, "import_tax": fx.IMPORT_TAX, "domestic_shipping": fx.DOMESTIC_SHIPPING, "international_shipping": fx.INTERNATIONAL_SHIPPING}
_NET = f"sell_usd - buy_usd - ({' + '.join(FEE_COLUMNS)})"
PROFIT_COLUMNS = {"fees": fx.rounded(" + ".join(FEE_COLUMNS), 2), "net_profit": fx.rounded(_NET, 2), "roi": fx.rounded(f"CASE WHEN buy_usd > 0 THEN ({_NET}) / buy_usd ELSE 0.0 END", 4), "margin": fx.rounded(f"CASE WHEN sell_usd > 0 THEN ({_NET}) / sell_usd ELSE 0.0 END", 4)}
HARD_FILTER = f"sell_usd > buy_usd AND net_profit >= {MIN_PROFIT} AND margin >= {MIN_MARGIN} AND roi >= {MIN_ROI} AND roi <= {MAX_ROI} AND sell_usd / buy_usd <= {MAX_RATIO}"


def scored(pairs: DataFrame) -> DataFrame:
    """Penalties, the seven factors and the three scores, all of them expressions."""
    out = pairs.withColumns({"soft_penalty": F.expr(fx.SOFT_PENALTY), "confidence_penalty": F.expr(fx.CONFIDENCE_PENALTY)})
    out = out.withColumns({name: F.expr(e) for name, e in fx.FACTORS.items()})
    return out.withColumns({name: F.expr(fx.doubles(e)) for name, e in {"opportunity_score": fx.opportunity_score(), "risk_score": fx.RISK_SCORE, "confidence_score": fx.CONFIDENCE_SCORE}.items()})


def best_per_product(pairs: DataFrame) -> DataFrame:
    """The pair of the highest score; ties go to the cheaper buy, then the cheaper sell side, then by name."""
    order = Window.partitionBy("product_id").orderBy(F.col("opportunity_score").desc(), "buy_usd", "min_usd", "buy_mp", "sell_mp")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def clean_listings(listings: DataFrame) -> DataFrame:
    """Trusted listings of several markets' products without outliers, with n_listings of their product.

    All of it is windows by product, so the listings are shuffled once.
    """
    of_product = Window.partitionBy("product_id")
    kept = without_outliers(trusted(listings)).withColumn("n_listings", F.count("*").over(of_product))
    return kept.withColumn("_markets", F.size(F.collect_set("mp").over(of_product))).where("_markets >= 2").drop("_markets")


def with_variants(clean: DataFrame) -> DataFrame:
    """clean listings with fits and variant_no, by condition, title and the rules of variants.

    What is bought are the cheapest listings of each marketplace. Their distinct variants are numbered within the product
    from 1: variant_no is a listing's own (0 if none is bought in it), fits holds those that it may be sold against.
    Listings without a title fit by condition. Windows by product, on the partitioning that clean_listings leaves.
    """
    of_product = Window.partitionBy("product_id")
    rows = clean.columns
    named = clean.withColumn("_title", F.coalesce("title", F.lit("")))
    # Equal titles fit, so features are only taken where the titles of a product differ.
    differ = F.min("_title").over(of_product) != F.max("_title").over(of_product)
    told = named.withColumn("_differ", differ).select("*", F.struct("condition", "_title", F.when(F.col("_differ"), va.told("_title", "condition")).alias("told")).alias("variant"))
    told = told.withColumn("_cheapest", F.first("variant").over(Window.partitionBy("product_id", "mp").orderBy("usd", "url")))
    told = told.withColumn("_bought", F.array_sort(F.collect_set("_cheapest").over(of_product))).withColumn("variant_no", F.array_position("_bought", F.col("variant")))
    fits = f"b.x.condition = variant.condition AND (b.x._title = variant._title OR {va.fits_within('b.x.told', 'variant.told')})"
    return told.select(*rows, F.col("variant_no").cast("int"), F.expr(f"transform(filter(transform(_bought, (x, i) -> struct(i + 1 AS no, x AS x)), b -> {fits}), b -> b.no)").alias("fits"))


def opportunity_pairs(spark: SparkSession, clean: DataFrame) -> DataFrame:
    """Every pair that passes the hard filters, with all signals and scores. clean holds listings with their facts."""
    clean = clean.withColumn("stability", F.expr(fx.STABILITY))
    stats = marketplace_stats(clean)
    pairs = competition(route_pairs(stats, dimension(spark, "routes")), clean)
    pairs = with_fees(pairs, spark).where(HARD_FILTER)
    return scored(pairs.join(market_depth(clean).withColumnRenamed("mp", "sell_mp"), ["product_id", "sell_mp"]))


def opportunities(spark: SparkSession, clean: DataFrame) -> DataFrame:
    """The best pair of each product."""
    return best_per_product(opportunity_pairs(spark, clean))
