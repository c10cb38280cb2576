"""State folded over many cycles per key: rows are shuffled by key and sorted by cycle, and a task holds one key's state.

A cycle in which a key had nothing still counts: counters decay all the same, averages stay. The fold is a stream, so
a key of any number of cycles is no larger than its state; keys spread over tasks. Null counts are zero.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is left of counters after a cycle, and the two rates of an average.
DECAY, OLD_RATE, NEW_RATE = 0.9, 0.7, 0.3


def every_cycle(rows: DataFrame, key: str, cycle: str) -> DataFrame:
    """rows(key, cycle, ...) with a row for each cycle from a key's first to the last of all; what a new one has is null.

    Cycles are whole numbers, one row per key and cycle.
    """
    last = rows.agg(F.max(cycle).alias("_last"))  # one row
    grid = rows.groupBy(key).agg(F.min(cycle).alias("_first")).join(F.broadcast(last)).select(key, F.explode(F.sequence("_first", "_last")).alias(cycle))
    return grid.join(rows, [key, cycle], "left")


def fold(rows: DataFrame, key: str, cycle: str, start: Callable[[], tuple], step: Callable[[tuple, dict], tuple], schema: str) -> DataFrame:
    """key, cycle and the state after each cycle, whose columns ``schema`` names; step(state, row) gives the next state."""
    names = [c.split()[0] for c in schema.split(", ")]

    def folded(batches):
        last, state = None, None
        for batch in batches:
            states = []
            for row in batch.to_pylist():
                if state is None or row[key] != last:
                    last, state = row[key], start()
                state = step(state, row)
                states.append(state)
            columns = [pa.array(c) for c in zip(*states)] or [pa.array([]) for _ in names]
            yield pa.RecordBatch.from_arrays([batch[key], batch[cycle], *columns], [key, cycle, *names])

    kinds = dict(rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, cycle).mapInArrow(folded, f"{key} {kinds[key]}, {cycle} {kinds[cycle]}, {schema}")


YIELD = "total long, found long, profitable long, roi double, cycles long"


def yield_start() -> tuple:
    return 0, 0, 0, 0.0, 0


def yield_step(state: tuple, row: dict) -> tuple:
    """Counters take a cycle's counts and decay to whole numbers; a positive average moves the old one by three tenths."""
    total, found, profitable, roi, cycles = state
    new = row["roi"] or 0.0
    if new > 0:
        roi = roi * OLD_RATE + new * NEW_RATE if roi > 0 else new
    counts = [int((old + (row[name] or 0)) * DECAY) for name, old in (("listings", total), ("found", found), ("profitable", profitable))]
    return (*counts, roi, cycles + (row["listings"] is not None))


def category_cycles(rows: DataFrame) -> DataFrame:
    """State of each category after each cycle, for rows(category, cycle, listings, found, profitable, roi)."""
    return fold(every_cycle(rows, "category", "cycle"), "category", "cycle", yield_start, yield_step, YIELD)


# Parameters with their first value, least and most; rate of the average, largest step in a cycle, and the guardrails.
PARAMETERS = {"profit_buffer_pct": (0.05, 0.0, 0.30), "decay_rate_per_hour": (0.005, 0.0, 0.10), "confidence_threshold": (0.30, 0.10, 0.95), "min_roi": (0.15, 0.01, 0.40), "min_profit_usd": (20.0, 1.0, 100.0)}
RATE, KEPT_RATE, LARGEST_STEP, LEAST_STEP = 0.3, 0.7, 0.05, 0.001
LEAST_SAMPLES, LEAST_SUCCESS, MOST_FALSE = 10, 0.5, 0.5
CALIBRATION = ", ".join([*(f"{n} double" for n in PARAMETERS), *(f"{n}_average double" for n in PARAMETERS), "frozen boolean", "version long", "outcome string"])


def calibration_start() -> tuple:
    first = tuple(x[0] for x in PARAMETERS.values())
    return (*first, *first, False, 0, "")


def targets(values: tuple, row: dict) -> tuple:
    """What a cycle's feedback would set the parameters to, in their order."""
    _, _, confidence, roi, profit = values
    drift = row["drift"]
    roi += 0.01 if drift < -5 else -0.005 if drift > 5 else 0.0
    profit += 2.0 if drift < -10 else -1.0 if drift > 10 else 0.0
    return row["buffer"], row["decay"], confidence + row["delta"], roi, profit


def calibration_step(state: tuple, row: dict) -> tuple:
    """Averages move towards the targets, parameters towards the averages by a bounded step; poor results freeze all of it."""
    values, averages, (frozen, version, _) = state[:5], state[5:10], state[10:]
    if row["samples"] < LEAST_SAMPLES:
        return (*values, *averages, frozen, version, "samples")
    if row["success_rate"] < LEAST_SUCCESS:
        return (*values, *averages, True, version, "success_rate")
    if row["false_rate"] > MOST_FALSE:
        return (*values, *averages, True, version, "false_positive_rate")
    averages = tuple(RATE * t + KEPT_RATE * a for t, a in zip(targets(values, row), averages))
    moved = []
    for value, average, (_, least, most) in zip(values, averages, PARAMETERS.values()):
        step = max(abs(value) * LARGEST_STEP, LEAST_STEP)
        bounded = min(most, max(least, value + max(-step, min(step, average - value))))
        moved.append(int(bounded * 1e6 + 0.5) / 1e6)
    return (*moved, *averages, False, version + 1, "applied")


def calibrated(rows: DataFrame) -> DataFrame:
    """The parameters of each key after each cycle, for rows(key, cycle, samples, success_rate, false_rate, buffer, decay, delta, drift) without nulls."""
    return fold(rows, "key", "cycle", calibration_start, calibration_step, CALIBRATION)
