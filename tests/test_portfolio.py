"""Search terms, nested items, cooldowns and the selection under limits, against plain loops and written values."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import keywords as kw
from tidemark.functions import pages as pg
from tidemark.operators.cooldown import last_within
from tidemark.operators.levels import by_levels, unit
from tidemark.plans import crawl_queries as cq
from tidemark.plans import portfolio_queries as pq


def test_expansion(spark):
    terms = ["USB Hub", " sony ", "sony tv", "cable", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(kw.expanded(F.col("t"))).collect()]
    assert got[0] == ["usb hub", "usb-c hub", "type-c hub", "multiport usb hub", "docking station usb", "usb hub inalambrico", "usb hub bluetooth", "usb hub wifi", "usb hub pro"]
    assert got[1][:6] == ["sony", "sony wh-1000xm5", "sony wh-1000xm4", "sony wf-1000xm5", "sony playstation", "sony ps5"] and len(got[1]) == 9
    assert got[2][0] == "sony tv" and "sony ps5" in got[2] and got[4] is None
    assert got[3][:5] == ["cable", "cable usb", "cable hdmi", "cable lightning", "cable tipo c"]


def nest(item, levels):
    for _ in range(levels):
        item = {"x": item}
    return item


def test_nested_items(spark):
    a, b = {"productId": "a"}, {"itemId": "b"}
    cases = [
        ({"x": [a, b]}, ["a", "b"]),
        ({"productId": "a", "sub": b}, ["a", "b"]),
        ([{"productId": "a", "sub": b}], ["a"]),
        ({"x": [[a]], "y": [{"z": b}]}, ["b"]),
        (nest(a, 10), ["a"]),
        (nest(a, 11), []),
        (nest([a], 10), ["a"]),
        (nest([a], 11), []),
        (7, []),
    ]
    texts = [json.dumps(data) for data, _ in cases] + [None, "", "{broken"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pg.find_items("t").alias("x")).orderBy("i").collect()
    ids = [[item.get("productId") or item["itemId"] for item in map(json.loads, r["x"])] for r in rows]
    assert ids == [wanted for _, wanted in cases] + [[], [], []]


def test_rates_follow_blocks(spark):
    windows = [(1, d, n, b) for d, (n, b) in enumerate([(100, 31), (100, 30), (100, 4), (20, 0), (21, 0)])] + [(2, d, 10, 9) for d in range(8)] + [(3, d, 30, 0) for d in range(30)]
    rows = cq.adapted(spark.createDataFrame(windows, "mp long, day long, requests long, blocks long")).orderBy("mp", "day").collect()
    rates = {mp: [round(r["rate"], 6) for r in rows if r["mp"] == mp] for mp in (1, 2, 3)}
    assert rates[1] == [1.0, 1.0, 1.1, 1.1, 1.21]
    assert rates[2][-1] == 0.1 and rates[3][-1] == 10.0


def test_last_within(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None] + [draw.randrange(-50, 400)] * 9)) for i in range(400)]
    events = [(draw.choice([1, 1, 2, 4, None]), draw.randrange(-50, 400)) for _ in range(60)] * 2 + [(1, None)]
    got = last_within(spark.createDataFrame(rows, "i int, k int, t long"), spark.createDataFrame(events, "k int, t long"), "k", "t", 7, "last").collect()
    wanted = {i: max((e for k2, e in events if k is not None and k2 == k and None not in (e, t) and e <= t < e + 7), default=None) for i, k, t in rows}
    assert len(got) == 400 and {r["i"]: r["last"] for r in got} == wanted
    assert any(v is not None for v in wanted.values())


def test_selection_meets_every_limit(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(12), f"r{draw.randrange(6)}", float(draw.randrange(20, 400)), float(draw.randrange(20, 90)), 1 / (i + 1)) for i in range(200)]
    got = {r["place"]: r["verdict"] for r in pq.selected(spark.createDataFrame(rows, "product_id long, route string, buy_usd double, risk_score double, density double")).collect()}
    left, chosen, wanted = pq.CAPITAL, [], {}
    for place, (product, route, usd, risk, _) in enumerate(rows, 1):
        limits = [("capital", usd > left), ("risk", risk > pq.MOST_RISK), ("positions", len(chosen) >= pq.MOST_OPEN), ("product", sum(p == product for p, _ in chosen) >= pq.PER_PRODUCT), ("route", sum(r == route for _, r in chosen) >= pq.PER_ROUTE)]
        wanted[place] = next((name for name, met in limits if met), "approved")
        if wanted[place] == "approved":
            left, chosen = left - usd, [*chosen, (product, route)]
    assert got == wanted and {"approved", "risk", "product", "route"} <= set(wanted.values())


def test_levels(spark):
    known = [
        (1, "b", "m", "main", 100.0, 5, [1.0, 0.0]), (2, "b", "m", "main", 100.0, 5, [0.8, 0.6]), (3, "b", None, "main", 100.0, 5, [0.8, -0.6]),
        (4, "b", "x", "main", 100.0, 5, [0.99, 0.1]), (5, "c", "m", "accessory", 100.0, 5, [0.0, 1.0]), (6, "c", "m", "main", 100.0, 2, [0.1, 0.99]), (7, "c", "m", "main", 100.0, 5, [1.0, 0.0]),
    ]
    asked = [
        (20, "b", "m", "main", 100.0, [1.0, 0.0], ("model", 1)),
        (21, "b", "m", "main", 400.0, [1.0, 0.0], (None, None)),  # prices too far apart on every level
        (22, "b", "z", "main", 100.0, [0.8, -0.6], ("brand", 3)),  # only the product without a model is compatible
        (23, "b", None, "main", 100.0, [0.98, 0.1], ("brand", 4)),
        (24, None, None, "main", 100.0, [0.0, 1.0], (None, None)),  # the most similar of all is an accessory; no second best
        (25, "?", None, "main", 1000.0, [0.1, 0.99], ("any", 6)),  # a median of two prices does not count
        (26, None, "m", "main", 100.0, [1.0, 0.0], ("any", 1)),  # ties go to the least id
        (27, "b", "m", "main", 0.0, [0.6, 0.8], ("model", 2)),
    ]
    k = spark.createDataFrame(known, "product_id long, brand string, model string, kind string, median double, n_prices long, v array<double>").withColumn("v", unit(F.col("v")))
    q = spark.createDataFrame([a[:6] for a in asked], "q_id long, q_brand string, q_model string, q_kind string, q_price double, q_v array<double>").withColumn("q_v", unit(F.col("q_v")))
    assert {r["q_id"]: (r["level"], r["product_id"]) for r in by_levels(q, k, 3).collect()} == {a[0]: a[6] for a in asked}
