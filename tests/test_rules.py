"""Single rules against values worked out by hand, and folds against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import variants as va
from tidemark.plans import rule_queries
from tidemark.operators import scan, series

NEW, USED = "new", "used"


def judge(spark, cases):
    rows = [(i, side, title, condition) for i, (b, bc, s, sc, *_) in enumerate(cases) for side, title, condition in (("b", b, bc), ("s", s, sc))]
    df = va.with_features(spark.createDataFrame(rows, "i int, side string, title string, condition string"), "title").drop("title")
    buys, sells = va.sides(df, ["i"])
    pairs = buys.where("b_side = 'b'").join(sells.where("s_side = 's'"), "i")
    return [(r["compatible"], r["same_title"]) for r in va.judged(pairs).orderBy("i").collect()]


def test_variants(spark):
    cases = [
        ("iPhone 15 128GB", NEW, "iPhone 15 128 gb", NEW, True),
        ("iPhone 15 128GB", NEW, "iPhone 15 256GB", NEW, False),
        ("iPhone 15 128GB", USED, "iPhone 15 128GB", NEW, False),
        ("iPhone 15 Reacondicionado", NEW, "iPhone 15", NEW, False),
        ("Funda para auriculares", NEW, "Auriculares con estuche", NEW, False),
        ("Garmin Edge 540", NEW, "Garmin Edge 1040", NEW, False),
        ("Sony WH-1000XM4", NEW, "Sony WH1000XM4 negro", NEW, True),
        ("Sony WH-1000XM4", NEW, "Sony WF-1000XM4", NEW, False),
        ("Power bank 10000 mAh", NEW, "Power bank 20000mah", NEW, False),
        ("PS5 con disco", NEW, "PS5 edición digital", NEW, False),
        ("Consola con juegos", NEW, "Consola combo", NEW, False),
        ("Teclado para el iPad", NEW, "Teclado para iMac", NEW, False),
        ("Teclado para iPad", NEW, "Teclado", NEW, True),
    ]
    assert [c for c, _ in judge(spark, cases)] == [c[-1] for c in cases]


def test_titles(spark):
    cases = [
        ("iPhone 17 Pro 256", NEW, "Apple iphone  17 pro", NEW, True),
        ("iPhone 17 Pro", NEW, "iPhone 17e", NEW, False),
        ("iPhone 17", NEW, "Apple phone", NEW, False),
        ("bocina portatil azul", NEW, "bocina portatil roja", NEW, True),
        ("bocina portatil", NEW, "silla de madera", NEW, False),
        ("de la", NEW, "silla", NEW, True),
        ("", NEW, "silla", NEW, True),
        (None, NEW, "silla", NEW, True),
    ]
    assert [t for _, t in judge(spark, cases)] == [c[-1] for c in cases]


def test_ambiguous_numbers(spark):
    cases = {"1.299,99": 1299.99, "1,299.99": 1299.99, "405.188": 405188.0, "29.99": 29.99, "1.000.000": 1000000.0, "1,000,000": 1000000.0, "5,299": 5299.0, "193,70": 193.70, "193,7": 193.7, "1234.5678": 1234.5678, "12,3456": 123456.0, "7": 7.0}
    df = spark.createDataFrame([(x,) for x in cases], "x string").select("x", F.expr(f"try_cast({rule_queries._AMBIGUOUS} AS double)").alias("v"))
    assert {r["x"]: r["v"] for r in df.collect()} == cases


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_repeats_in_time_match_a_loop(spark, batch):
    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(f"k{min(i % 7, 3)}", start + datetime.timedelta(seconds=rng.randrange(5000)), i) for i in range(400)]
    seen, want = {}, {}
    for key, at, i in sorted(rows):
        want[i] = key not in seen or (at - seen[key]).total_seconds() > 120
        if want[i]:
            seen[key] = at
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rule_queries.kept_after_gap(spark.createDataFrame(rows, "k string, at timestamp, i long"), "k", "at", "i", 120).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r["i"]: r["kept"] for r in got} == want


def test_categories_and_hashes(spark):
    titles = {"New MacBook Air": "Laptops", "Galaxy Tab S9": "Tablets", "XIAOMI 13 super Ultra": "Smartphones", "Sony WH-1000XM5": "Headphones", "earbud": "Headphones", "PS5": "Gaming Consoles", "Control para PS5": "Gaming Consoles", "Televisión 50": "TVs & Monitors", "funda": "Phone Accessories", "gato": "Other"}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", tx.category(F.col("t")).alias("c")).collect()} == titles
    rows = spark.createDataFrame([("café ñandú!",), ("caf and",), ("ソニー",), ("任天堂",), ("CAFÉ  ñandú",)], "t string")
    hashes = [r[0] for r in rows.select(tx.listing_hash(F.col("t"), F.lit("x"), F.lit(1.5))).collect()]
    assert hashes[0] == hashes[4] and len(set(hashes)) == 4


def test_forecast_of_short_series(spark):
    rows = [(1, 0, 10.0), (1, 1, 12.0), (1, 2, 14.0), (2, 0, 5.0), (2, 3, 6.0), (3, 4, 7.0), (3, 4, 7.0), (3, 4, 7.0)]
    got = {r["product_id"]: r for r in series.linear_forecast(spark.createDataFrame(rows, "product_id int, day int, price double")).collect()}
    assert abs(got[1]["predicted"] - 28.0) < 1e-9 and got[2]["status"] == "failed" and got[2]["predicted"] is None and abs(got[3]["predicted"] - 7.0) < 1e-9


def test_unknown_marketplace_takes_default_fees(spark):
    pairs = spark.createDataFrame([(1, "amazon_us", "nowhere", 10.0, 100.0, False), (2, "amazon_us", "ebay", 10.0, 100.0, False)], "product_id int, buy_mp string, sell_mp string, buy_usd double, sell_usd double, sell_free boolean")
    got = {r["product_id"]: r for r in scan.with_fees(pairs, spark).collect()}
    assert abs(got[1]["marketplace_fee"] - 13.12) < 1e-9 and abs(got[1]["domestic_shipping"] - 8) < 1e-9 and abs(got[1]["import_tax"] - (100 + 2 + 40) * 0.20) < 1e-9
    assert got[2]["import_tax"] == 0.0


def test_scan_sells_only_variants_that_fit(spark):
    """The cheapest of each marketplace is bought; what it is sold against fits it by condition, title and variant."""
    titles = [
        ("a", "u1", "new", "iPhone 15 128GB", 100.0), ("a", "u2", "new", "iPhone 15 256GB", 150.0), ("b", "u3", "new", "iPhone 15 128 gb", 300.0), ("b", "u4", "new", "iPhone 15 256GB", 390.0),
        ("b", "u5", "new", "Funda para iPhone 15", 290.0), ("b", "u6", "used", "iPhone 15 128GB", 280.0), ("b", "u7", "new", "iPhone 15", 310.0), ("b", "u8", "new", "iPhone 14 128GB", 295.0), ("b", "u9", "new", None, 320.0),
    ]
    rows = spark.createDataFrame([(1, *t) for t in titles] + [(2, "a", "v1", "new", "ring", 10.0), (2, "b", "v2", "new", "ring", 40.0), (2, "b", "v3", "used", "ring", 50.0)], "product_id long, mp string, url string, condition string, title string, usd double")
    got = {r["url"]: r for r in scan.with_variants(rows).collect()}
    assert len(got) == len(titles) + 3
    bought = got["u1"]["variant_no"]
    assert bought > 0 and {u for u, r in got.items() if bought in r["fits"] and r["product_id"] == 1} == {"u1", "u3", "u7", "u9"}
    used = got["u6"]["variant_no"]
    assert used > 0 and [u for u, r in got.items() if used in r["fits"] and r["product_id"] == 1] == ["u6"]
    assert got["v1"]["variant_no"] == got["v2"]["variant_no"] == 1 and got["v1"]["fits"] == got["v2"]["fits"] == [1] and got["v3"]["fits"] == []
    assert {r["url"]: r["title"] for r in got.values()} == {t[1]: t[3] for t in titles} | {"v1": "ring", "v2": "ring", "v3": "ring"}
    sold = scan.offers(scan.with_variants(rows.selectExpr("*", "5.0 AS rating", "1L AS reviews", "true AS free_ship", "timestamp_ntz '2001-01-01' AS scraped_at"))).where(f"product_id = 1 AND sell_mp = 'b' AND buy_variant = {bought}").first()
    assert (sold["n"], sold["lowest_usd"], sold["sell_url"]) == (3, 300.0, "u9")
