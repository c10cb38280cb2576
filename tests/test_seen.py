"""Hashes seen before, against a plain set; with a filter that is full, and with one that is nearly empty."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.seen import SeenSet
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [6, 20])
def test_against_a_set(spark, tmp_path, bits):
    draw, seen, known = random.Random(bits), SeenSet(spark, f"file://{tmp_path}/s", bits), set()
    for batch in range(4):
        rows = [(draw.choice([None, *[f"h{x}" for x in range(400)]]), i) for i in range(150)] if batch != 2 else []
        got = sorted(tuple(r) for r in seen.add(batch, spark.createDataFrame(rows, "h string, i long"), "h", ["i"]).collect())
        first = {}
        for h, i in rows:
            if h is not None and h not in known:
                first.setdefault(h, i)
        assert got == sorted(first.items())
        again = sorted(tuple(r) for r in seen.add(batch, spark.createDataFrame(rows, "h string, i long"), "h", ["i"]).collect())
        assert again == got
        known |= set(first)


def test_filter_spares_most_lookups(spark, tmp_path):
    """With room enough nearly all new hashes are told by the filter alone, and no known one is missed."""
    seen = SeenSet(spark, f"file://{tmp_path}/s", 18)
    rows = spark.range(2000).selectExpr("concat('a', id) AS h", "id")
    seen.add(0, rows, "h", ["id"])
    filter_ = spark.read.parquet(f"file://{tmp_path}/s/filter/batch=0")
    asked = rows.unionByName(spark.range(2000).selectExpr("concat('b', id) AS h", "id"))
    told = {r["h"]: r["_known"] for r in seen._may_be_known(asked, filter_, "h").collect()}
    assert len(told) == 4000 and all(told[f"a{i}"] for i in range(2000))
    assert sum(told[f"b{i}"] for i in range(2000)) < 20


def test_both_hashes(spark):
    """Written titles; half prices go to the even unit."""
    rows = [(" Apple iPhone-13, 128GB ", "amazon", 2.5), ("Ñandú  X", "ebay", 3.5), ("a", "b", 10.0)]
    got = spark.createDataFrame(rows, "t string, m string, p double").select(tx.listing_hash_v2(F.col("t"), F.col("m"), F.col("p")), tx.listing_hash(F.col("t"), F.col("m"), F.col("p"))).collect()
    assert [r[0] for r in got] == [hashlib.sha256(f"{t.strip().lower()}|{m}|{p:.0f}".encode()).hexdigest() for t, m, p in rows]
    assert [r[1] for r in got] == [hashlib.sha256(f"{t}|{m}|{p:.2f}".encode()).hexdigest()[:16] for (t, (_, m, p)) in zip(["apple iphone13 128gb", "ñandú x", "a"], rows)]


def test_lifecycles_differ(spark):
    labels = {r["label"] for r in registry.QUERIES["q_lifecycle_history"](spark, "/root/testdata/sf0.01").collect()}
    assert {"stable", "decaying"} <= labels


def test_anomalies_are_told(spark):
    assert {r["anomaly"] for r in registry.QUERIES["q_stream_last20"](spark, SF).collect()} == {True, False}
