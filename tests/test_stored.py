"""Logs of changes in any sequence, partitions that are replaced and dropped, order statistics of hot keys: against plain Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.stored import ChangeLog, PartitionedTable

SCHEMA = "id long, at long, op string, name string, tags map<string,string>, place struct<x: int, y: array<int>>"


def _plain(changes):
    """The table after all changes, one after the other in order."""
    table = {}
    for id_, at, op, *values in sorted(changes, key=lambda c: c[1]):
        if id_ is None or op not in ("upsert", "delete"):
            continue
        if op == "delete":
            table.pop(id_, None)
        else:
            old = table.get(id_, (None, None, None))
            table[id_] = tuple(o if n is None else n for o, n in zip(old, values))
    return table


def _read(log):
    return {r["id"]: (r["name"], r["tags"], r["place"].asDict() if r["place"] else None) for r in log.read().collect()}


def _changes(seed, n):
    draw = random.Random(seed)
    out = []
    for at in range(n):
        op = draw.choice(["upsert", "upsert", "upsert", "delete", "other"])
        values = [draw.choice([None, f"n{at}", ""]), draw.choice([None, {"a": str(at)}, {}]), draw.choice([None, {"x": at, "y": [at, None]}, {"x": None, "y": None}])]
        out.append((draw.choice([None, 1, 2, 3, 4, 5, 6, 7]), at, op, *values))
    return out


def test_change_log_in_any_sequence(spark, tmp_path):
    changes = _changes(5, 120)
    schema = spark.createDataFrame([], SCHEMA).schema
    wanted = _plain(changes)
    assert 0 < len(wanted) < 7
    parts = [changes[0:30], changes[60:120], changes[30:60]]
    log = ChangeLog(spark, f"file://{tmp_path}/log", ["id"], ["at"], schema)
    assert log.read().count() == 0
    log.compact()
    log.append(0, spark.createDataFrame(parts[0], schema))
    log.append(1, spark.createDataFrame(parts[1], schema))
    log.append(1, spark.createDataFrame(parts[1], schema))
    assert _read(log) == _plain(parts[0] + parts[1])
    log.compact()
    log.append(1, spark.createDataFrame(parts[1], schema))  # comes again after it was folded
    log.append(2, spark.createDataFrame(parts[2], schema))  # late: its order is before what is folded
    log.append(3, spark.createDataFrame([], schema))
    assert _read(log) == wanted
    again = ChangeLog(spark, f"file://{tmp_path}/log", ["id"], ["at"], schema)
    again.compact()
    assert _read(again) == wanted and again._batches() == [] and again._folded() == 3


def test_delete_then_upsert_starts_anew(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    log = ChangeLog(spark, f"file://{tmp_path}/log", ["id"], ["at"], schema)
    log.append(0, spark.createDataFrame([(1, 1, "upsert", "a", {"k": "v"}, None), (1, 2, "delete", None, None, None), (1, 3, "upsert", None, None, {"x": 1, "y": []}), (2, 1, "delete", None, None, None)], schema))
    assert _read(log) == {1: (None, None, {"x": 1, "y": []})}


def test_partitions(spark, tmp_path):
    table = PartitionedTable(spark, f"file://{tmp_path}/t", "month")
    schema = spark.createDataFrame([], "k long, month string").schema
    assert table.read(schema).count() == 0 and table.drop_before("2001-01") == []
    table.write(spark.createDataFrame([(1, "2000-01"), (2, "2000-02"), (3, "2000-02"), (9, None)], schema))
    table.write(spark.createDataFrame([(4, "2000-02"), (5, "2000-03")], schema))
    table.write(spark.createDataFrame([(4, "2000-02"), (5, "2000-03")], schema))
    assert sorted(r["k"] for r in table.read(schema).collect()) == [1, 4, 5, 9]
    assert table.drop_before("2000-02") == ["2000-01"] and table.drop_before("2000-02") == []
    assert sorted(r["k"] for r in table.read(schema).collect()) == [4, 5, 9]


def test_order_statistics_of_a_hot_key(spark):
    draw = random.Random(3)
    rows = [("hot", float(draw.choice([1, 2, 2, 2, draw.random()]))) for _ in range(3000)] + [("one", 7.0), (None, 1.0), (None, 2.0), ("none", None), ("hot", None)]
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r["k"]: tuple(r)[1:] for r in ranks.by_index(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    wanted = {}
    for k in ("hot", "one", None):
        v = sorted(x for key, x in rows if key == k and x is not None)
        wanted[k] = (len(v), v[0], v[-1], *[v[int(len(v) * q)] for q in shares.values()])
    assert got == wanted


def test_order_statistics_of_nothing(spark):
    assert ranks.by_index(spark.createDataFrame([], "k string, v double"), "k", "v", {"p50": 0.5}).count() == 0
    run = ranks.running_counts(spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") % 10).alias("v")), "k", "v")
    assert [(r["v"], r["n"], r["upto"], r["total"]) for r in run.orderBy("v").collect()] == [(i, 100, 100 * (i + 1), 1000) for i in range(10)]
