"""The last event of a key within a time before each row, as one shuffle by key and stretch of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_within(rows: DataFrame, events: DataFrame, key: str, at: str, within: int, name: str) -> DataFrame:
    """rows with ``name``: the latest time of an event of their key in the ``within`` seconds before or at theirs, or null.

    rows and events(key, at) hold times in whole seconds; an event exactly ``within`` before is over. Each event goes to
    its own stretch of ``within`` seconds and the next one, so a key with a third of all rows is split by time, and no
    row is compared with each event. Rows without a key or time keep null. Equal rows stay.
    """
    stretch = F.floor(F.col(at) / within)
    known = events.select(key, F.col(at).alias("_event")).where(F.col(key).isNotNull() & F.col("_event").isNotNull()).groupBy(key, "_event").agg(F.lit(True).alias("_is_event"))
    known = known.withColumn("_stretch", F.explode(F.array(F.floor(F.col("_event") / within), F.floor(F.col("_event") / within) + 1)))
    asked = rows.withColumn("_stretch", stretch).withColumn("_is_event", F.lit(False))
    both = asked.unionByName(known.withColumn(at, F.col("_event")).select(key, at, "_event", "_stretch", "_is_event"), allowMissingColumns=True)
    # Events at the same time as a row are peers of it and count.
    before = Window.partitionBy(key, "_stretch").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.max("_event").over(before)).where("not _is_event")
    return seen.withColumn(name, F.when(F.col("_last") + within > F.col(at), F.col("_last"))).drop("_last", "_event", "_stretch", "_is_event")
