"""Streams over several files, stopped and started again."""

import datetime
import random

from tests.compare import database
from tidemark.plans import registry
from tidemark.sources.shared import shared_folder
from tidemark.streaming import jobs, redelivery

SF = "/root/testdata/sf0.001"


def pieces(spark, folder, part):
    """A third of the events, in order of time, as files events0.parquet and so on."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    step = len(rows) // 3 + 1
    own = rows.iloc[part * step : (part + 1) * step]
    half = len(own) // 2 + 1
    for k in range(2):
        own.iloc[k * half : (k + 1) * half].to_parquet(f"{folder}/events{part}{k}.parquet", coerce_timestamps="us")


def resumed(spark, tmp_path, job):
    """A job's result after three runs with new files before each, one file per batch."""
    home, out = shared_folder(spark, "resumed"), None
    for part in range(3):
        pieces(spark, tmp_path, part)
        out = job(str(tmp_path), home)
    return out


def wanted(name):
    result = database(SF).execute(registry.ORACLES[name])
    return {tuple(sorted(zip([c[0] for c in result.description], row))) for row in result.fetchall()}


def got(df):
    return {tuple(sorted(r.asDict().items())) for r in df.collect()}


def test_dedup_goes_on(spark, tmp_path):
    assert got(resumed(spark, tmp_path, lambda d, h: jobs.deduplicated(spark, d, home=h, files=1))) == wanted("q_stream_dedup_ttl")


def test_states_go_on(spark, tmp_path):
    out = resumed(spark, tmp_path, lambda d, h: jobs.latest_states(spark, d, home=h, files=1))
    assert got(out.select("user_id", "event_id", "event_type")) == wanted("q_stream_upsert")


def test_states_without_news(spark, tmp_path):
    home = shared_folder(spark, "resumed")
    pieces(spark, tmp_path, 0)
    first = got(jobs.latest_states(spark, str(tmp_path), home=home))
    assert got(jobs.latest_states(spark, str(tmp_path), home=home)) == first


def test_retries_go_on(spark, tmp_path):
    """A stop after each file gives what one run gives; the table of progress has every batch of all runs."""
    home = shared_folder(spark, "resumed")
    for part in range(3):
        pieces(spark, tmp_path, part)
        out = redelivery.redelivered(spark, str(tmp_path), home=home, files=1)
    assert got(out) == wanted("q_stream_retry")
    told = redelivery.taken(spark, home).first()
    assert told["rows"] == spark.read.parquet(str(tmp_path)).count() and told["batches"] >= 6


def test_redelivery_ends(spark, tmp_path):
    """Done at once, done after a failure has passed, dead after the fourth delivery, unusable, and still waiting; with a stop between deliveries."""
    start, home = datetime.datetime(2024, 1, 1), shared_folder(spark, "resumed")
    row = lambda i, minutes, user, kind, value=1.0: (i, start + datetime.timedelta(minutes=minutes), user, kind, value)
    first = [row(1, 0, 1, "view"), row(2, 10, 1, "error"), row(3, 20, 1, "view"), row(4, 0, 2, "click", None), row(10, 0, 3, "error"), row(5, 5, 3, "view")]
    later = [*[row(10 + k, 30 * k, 3, "error") for k in range(1, 9)], row(6, 400, 4, "error"), row(7, 401, 4, "view"), row(8, 420, 5, "view")]

    def told(k, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").toPandas().to_parquet(f"{tmp_path}/events{k}.parquet", coerce_timestamps="us")
        return {r["event_id"]: (r["deliveries"], r["outcome"]) for r in redelivery.redelivered(spark, str(tmp_path), home=home).collect()}

    assert told(0, first) == {1: (1, "done")}
    assert told(1, later) == {1: (1, "done"), 3: (3, "done"), 4: (4, "dead"), 5: (4, "dead"), 8: (1, "done")}


def test_anomalies_go_on(spark, tmp_path):
    """Batches of one file give what the twin gives: keys start anew by event time, not by the cut into batches."""
    out = resumed(spark, tmp_path, lambda d, h: jobs.anomalies(spark, d, ttl_ms=24 * 3_600_000, home=h, files=1))
    assert got(out) == wanted("q_stream_last20")


def test_lag_of_a_second_run(spark, tmp_path):
    home = shared_folder(spark, "resumed")
    pieces(spark, tmp_path, 0)
    jobs.lag(spark, str(tmp_path), home=home)
    pieces(spark, tmp_path, 1)
    row = jobs.lag(spark, str(tmp_path), home=home).first()
    new = spark.read.parquet(f"{tmp_path}/events10.parquet", f"{tmp_path}/events11.parquet").count()
    assert (row["taken"], row["behind"], row["status"]) == (new, 0, "ok")


def test_anomalies_start_warm(spark, tmp_path):
    start, rng = datetime.datetime(2024, 1, 1), random.Random(1)
    row = lambda i, user, value: (i, start + datetime.timedelta(minutes=i), user, "view", value)
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    history = spark.createDataFrame([row(i, 1, 100.0 + rng.random()) for i in range(30)], kind)
    spark.createDataFrame([row(40, 1, 900.0), row(41, 2, 900.0), row(42, 1, 101.0)], kind).toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    told = lambda h: {r["event_id"]: r["anomaly"] for r in jobs.anomalies(spark, str(tmp_path), history=h).collect()}
    assert told(history) == {40: True, 41: False, 42: False} and told(None) == {40: False, 41: False, 42: False}
