"""Recurrences over cycles against values worked out by hand and plain loops over written rows."""

import random

from tidemark.operators.cycles import PARAMETERS, calibrated, category_cycles

COUNTS = "category string, cycle int, listings long, found long, profitable long, roi double"
FEEDBACK = "key long, cycle int, samples long, success_rate double, false_rate double, buffer double, decay double, delta double, drift double"


def test_counters_decay_through_empty_cycles(spark):
    rows = [("a", 1, 100, 10, 5, 0.2), ("a", 4, 10, 1, None, 0.4), ("b", 3, 7, 7, 7, -0.1), ("b", 4, 1, 0, 0, 0.3)]
    got = {(r["category"], r["cycle"]): (r["total"], r["found"], r["profitable"], round(r["roi"], 6), r["cycles"]) for r in category_cycles(spark.createDataFrame(rows, COUNTS)).collect()}
    assert got == {
        ("a", 1): (90, 9, 4, 0.2, 1), ("a", 2): (81, 8, 3, 0.2, 1), ("a", 3): (72, 7, 2, 0.2, 1), ("a", 4): (73, 7, 1, 0.26, 2),
        ("b", 3): (6, 6, 6, 0.0, 1), ("b", 4): (6, 5, 5, 0.3, 2),
    }


def test_cycles_of_nothing(spark):
    assert category_cycles(spark.createDataFrame([], COUNTS)).count() == 0 and calibrated(spark.createDataFrame([], FEEDBACK)).count() == 0


def test_calibration_freezes_and_thaws(spark):
    """Too few samples change nothing, poor results freeze, the next good cycle goes on from the same average."""
    rows = [(1, 1, 20, 0.9, 0.1, 0.05, 0.005, 0.0, 0.0), (1, 2, 20, 0.4, 0.1, 0.3, 0.1, 0.5, -20.0), (1, 3, 9, 0.9, 0.1, 0.3, 0.1, 0.5, -20.0), (1, 4, 20, 0.9, 0.6, 0.3, 0.1, 0.5, 0.0), (1, 5, 20, 0.9, 0.1, 0.3, 0.1, 0.5, -20.0), (2, 1, 5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {(r["key"], r["cycle"]): r for r in calibrated(spark.createDataFrame(rows, FEEDBACK)).collect()}
    told = [(got[1, c]["outcome"], got[1, c]["frozen"], got[1, c]["version"]) for c in range(1, 6)]
    assert told == [("applied", False, 1), ("success_rate", True, 1), ("samples", True, 1), ("false_positive_rate", True, 1), ("applied", False, 2)]
    first = {n: x[0] for n, x in PARAMETERS.items()}
    assert all(got[1, c][n] == first[n] for c in (1, 2, 3, 4) for n in first) and got[2, 1]["outcome"] == "samples"
    # A step of five per cent, or of a thousandth where that is more.
    last = [got[1, 5][n] for n in PARAMETERS]
    assert [round(x, 6) for x in last] == [0.0525, 0.006, 0.315, 0.153, 20.6]


def test_parameters_stay_in_their_ranges(spark):
    rng = random.Random(1)
    rows = [(k, c, 50, 0.9, 0.1, rng.random(), rng.random(), rng.choice([-0.4, 0.4]), rng.choice([-30.0, 30.0])) for k in range(5) for c in range(300)]
    got = calibrated(spark.createDataFrame(rows, FEEDBACK)).collect()
    assert len(got) == 1500 and all(least <= r[n] <= most for r in got for n, (_, least, most) in PARAMETERS.items())
    of = {(r["key"], r["cycle"]): r for r in got}
    assert all(abs(of[k, c][n] - of[k, c - 1][n]) <= max(abs(of[k, c - 1][n]) * 0.05, 0.001) + 1e-6 for k in range(5) for c in range(1, 300) for n in PARAMETERS)
