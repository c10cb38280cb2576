"""Refused chunks, torn lines, and a sink that is down again during the replay."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.streaming import jobs
from tidemark.streaming.publish import publish

SF = "/root/testdata/sf0.001"


def _sink(down, out):
    def send(df, name):
        if name in down:
            raise ConnectionError(name)
        out[name] = {tuple(r) for r in df.collect()}

    return send


def test_refused_chunks_come_back_once(spark, tmp_path):
    out, down, home = {}, {"0-1", "0-2"}, f"file://{tmp_path}/home"
    rows = jobs.read_events(spark, SF).select("event_id", "ts", "user_id", "value", "props")
    send = _sink(down, out)
    log = publish(rows, home, send, F.col("event_id") % 5, 3)
    wanted = {tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(rows.columns).collect()}
    of = lambda *c: {r for r in wanted if min(r[0] % 5, 2) in c}
    assert out == {"0-0": of(0)}
    down.add("replay-0")
    with pytest.raises(StreamingQueryException):
        log.replay(send)
    down.clear()
    log.replay(send)
    assert out == {"0-0": of(0), "replay-0": of(1, 2)}
    log.replay(send)
    publish(rows, home, send, F.col("event_id") % 5, 3)
    assert sorted(out) == ["0-0", "replay-0"]


def test_torn_lines(spark, tmp_path):
    """Nulls, text with line feeds and quotes, NaN, microseconds; a torn line and one of a wrong type are set apart."""
    folder, home, out = tmp_path / "in", tmp_path / "home", {}
    folder.mkdir()
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)
    kind = "id long, at timestamp, text string, x double, tags array<string>"
    source = [(1, at, 'a\n"b"\\', 1.5, ["u", None]), (2, None, None, None, None), (None, at, "", float("inf"), [])]
    spark.createDataFrame(source, kind).write.mode("overwrite").parquet(f"file://{folder}/rows")
    rows = spark.readStream.schema(kind).parquet(f"file://{folder}/rows")
    log = publish(rows, f"file://{home}", _sink({"0-0"}, out), F.lit(None).cast("int"), 1)
    (home / "wal" / "log" / "torn").mkdir()
    (home / "wal" / "log" / "torn" / "lines.txt").write_text('{"id":7,"te\n{"id":8,"text":"whole"}\n{"id":"nine"}\n')
    told = {}
    log.replay(lambda df, name: told.setdefault(name, [tuple(r) for r in df.select("id", "at", "text", "x", "tags").collect()]))
    sent = sorted((r for rows in told.values() for r in rows), key=str)
    assert sent == sorted([*source, (8, None, "whole", None, None)], key=str)
    broken = sorted(r["value"] for r in spark.read.text(f"file://{home}/wal/broken/*").collect())
    assert broken == ['{"id":"nine"}', '{"id":7,"te']


def test_nothing_refused(spark, tmp_path):
    out, home = {}, f"file://{tmp_path}/home"
    log = publish(jobs.read_events(spark, SF).select("event_id"), home, _sink(set(), out), F.lit(0), 2)
    log.replay(_sink(set(), out))
    assert sorted(out) == ["0-0", "0-1"] and len(out["0-0"]) == 1000 and not out["0-1"]
