"""A stage that delivers again: what fails waits in state with its counter, a timer brings it back, the last failure is final.

The state of a user: the messages that wait (when they are due, how often they were delivered), and when the user's
service failed of late. A message fails for good if it can't be used, and for the time being if the service failed
within ``outage`` before the delivery. Time is event time: a first delivery is at the message's own moment, each later one
``delay`` after the last, made once the watermark has passed it. So a result depends on times alone, not on how input is
cut into batches, as long as files come in order of time within ``late``. Counters and timers are in the state store, and
a stop between two deliveries loses neither. Rows without time or user are left out.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.sources.shared import shared_folder
from tidemark.streaming.jobs import drain_told, read_events

#: Deliveries of a message before it is a dead letter: the first one and three more.
MOST_DELIVERIES = 4
DELAY_US, OUTAGE_US, LATE_MS = 1_800_000_000, 3_600_000_000, 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(us: int) -> int:
    return -(-us // 1000)


class Redelivery(StatefulProcessor):
    """Messages and failures of a user; yields a message once it is done or dead."""

    def __init__(self, delay_us: int = DELAY_US, outage_us: int = OUTAGE_US, most: int = MOST_DELIVERIES):
        self.delay_us, self.outage_us, self.most = delay_us, outage_us, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long", "due long, deliveries int, lost boolean")
        self.failures = handle.getListState("failures", "us long")

    def _down(self, failures: list[int], at: int) -> bool:
        return any(us < at < us + self.outage_us for us in failures)

    def _told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=["event_id", "deliveries", "outcome"]).astype({"event_id": "int64", "deliveries": "int32", "outcome": "str"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", "event_id"])
        failures = [x[0] for x in self.failures.get()] if self.failures.exists() else []
        known, out = len(failures), []
        failures += [int(x) for x in new.loc[new["failure"], "us"]]
        for us in failures[known:]:
            self.handle.registerTimer(_ms(us + self.outage_us))
        for us, event, lost in new.loc[~new["failure"], ["us", "event_id", "lost"]].itertuples(index=False):
            if lost or self._down(failures, us):
                due = int(us) + self.delay_us
                self.waiting.updateValue((int(event),), (due, 1, bool(lost)))
                self.handle.registerTimer(_ms(due))
            else:
                out.append((int(event), 1, "done"))
        if len(failures) > known:
            self.failures.put([(us,) for us in failures])
        return self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        failures = [x[0] for x in self.failures.get()] if self.failures.exists() else []
        still = mark * 1000
        for (event,), (due, deliveries, lost) in list(self.waiting.iterator()):
            first = due
            while _ms(due) <= mark:
                deliveries += 1
                if not lost and not self._down(failures, due):
                    out.append((event, deliveries, "done"))
                elif deliveries >= self.most:
                    out.append((event, deliveries, "dead"))
                else:
                    due += self.delay_us
                    continue
                self.waiting.removeKey((event,))
                break
            else:
                still = min(still, due)
                if due > first:
                    self.waiting.updateValue((event,), (due, deliveries, lost))
                    self.handle.registerTimer(_ms(due))
        kept = [us for us in failures if us + self.outage_us > still]
        if len(kept) < len(failures):
            self.failures.put([(us,) for us in kept]) if kept else self.failures.clear()
        return self._told(out)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def redelivered(spark: SparkSession, sf_dir: str, home: str | None = None, files: int = 64) -> DataFrame:
    """event_id, deliveries and outcome ('done' or 'dead') of the messages that are settled; the others still wait.

    Events other than errors are messages, unusable without a positive value; a user's errors are failures of the service.
    Done ones go to the next stage's folder, dead ones to the dead letters, each batch to a folder of its own.
    """
    home = home or shared_folder(spark, "redelivery")
    rows = read_events(spark, sf_dir, files).where("ts is not null and user_id is not null")
    rows = rows.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), (F.col("event_type") == "error").alias("failure"), (~F.coalesce(F.col("value") > 0, F.lit(False))).alias("lost"))
    rows = rows.withWatermark("ts", f"{LATE_MS // 1000} seconds")
    told = rows.groupBy("user_id").transformWithStateInPandas(Redelivery(), "event_id long, deliveries int, outcome string", "append", "EventTime")

    def each(df: DataFrame, k: int) -> None:
        # One pass of the state for both sinks, so a repeated batch writes the same rows to either.
        df.write.mode("overwrite").partitionBy("outcome").parquet(f"{home}/out/batch={k}")

    with _setting(spark, _PROVIDER, _ROCKS):
        drain_told(told, "append", each, home, "redelivery")
    return spark.read.schema("event_id long, deliveries int, outcome string, batch int").parquet(f"{home}/out").drop("batch")


def health(spark: SparkSession, sf_dir: str, settled: DataFrame, now: str, warn: int, critical: int, stale_minutes: int = 10) -> DataFrame:
    """Per event type: messages, how many still wait, dead letters, the age of the last one at ``now``, and a status."""
    all_ = read_table(spark, sf_dir).where("event_type <> 'error' and ts is not null and user_id is not null")
    both = all_.join(settled, "event_id", "left")
    told = both.groupBy("event_type").agg(
        F.count("*").alias("length"), F.count(F.when(F.col("outcome").isNull(), 1)).alias("lag"), F.count(F.when(F.col("outcome") == "dead", 1)).alias("dead"),
        F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 1_000_000).alias("age_s"),
    )
    status = F.when(F.col("lag") > critical, "critical").when((F.col("lag") > warn) | (F.col("age_s") > stale_minutes * 60), "warning").otherwise("ok")
    return told.withColumn("status", status)


def read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def taken(spark: SparkSession, home: str) -> DataFrame:
    """Batches and rows of all runs of a home, from its table of progress."""
    return spark.read.parquet(f"{home}/progress").agg(F.countDistinct("batch").alias("batches"), F.sum("rows").alias("rows"))

