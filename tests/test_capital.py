"""Capital evaluation against written cases and a plain loop over whole portfolios."""

import collections
import random

from tidemark.operators.capital import Limits, books, evaluate
from tidemark.plans.capital_queries import LIMITS, trades_and_candidates

CANDIDATES = "portfolio long, batch long, at_us long, opportunity_id long, product_id long, buy_mp string, sell_mp string, category string, score double, risk double, confidence double, required_cents long, profit double"
TRADES = "portfolio long, trade long, at_us long, pnl_cents long"
HOUR = 3_600_000_000


def decided(spark, trades, candidates, limits=Limits()):
    rows = evaluate(spark.createDataFrame(trades, TRADES), spark.createDataFrame(candidates, CANDIDATES), limits).collect()
    return {r["opportunity_id"]: (r["place"], r["approved"], r["cents"], r["reason"]) for r in rows}


def candidate(i, at=0, portfolio=1, batch=None, product=None, buy="a", sell="b", category="c", score=80.0, risk=50.0, confidence=0.9, required=1000, profit=10.0):
    return (portfolio, at if batch is None else batch, at, i, i if product is None else product, buy, sell, category, score, risk, confidence, required, profit)


def test_sizes(spark):
    """80 % of 20 % of 5000 is 800; risk 50 takes 30 % of it; a needed sum above that is given up to the cap of a trade."""
    apart = dict(category=None)
    got = decided(spark, [], [
        candidate(1, portfolio=1), candidate(2, portfolio=2, required=70_000), candidate(3, portfolio=3, required=120_000), candidate(4, portfolio=4, score=0.0), candidate(5, portfolio=5, score=1.0, required=10),
        candidate(6, portfolio=6, required=80_000, confidence=0.4), candidate(7, portfolio=7, confidence=None, required=None and 0 or 0, **apart),
    ])
    assert got[1] == (1, True, 56_000, "") and got[2] == (1, True, 70_000, "") and got[6] == (1, True, 60_000, "")
    assert got[3][3] == "sizing: above the cap of a trade" and got[4][3] == "sizing: zero base allocation" and got[5][3] == "sizing: below the minimum" and got[7][1]


def test_approvals_change_what_comes_after(spark):
    """Rank by confidence, profit and risk; a product and its marketplaces cool down; category and marketplace fill up; overflow is told its rank."""
    day = 24 * HOUR
    got = decided(spark, [], [
        candidate(1, profit=50.0), candidate(2, profit=40.0), candidate(3, profit=30.0, buy="d", sell="e", product=1), candidate(4, profit=20.0, buy="f", sell="g", category="h"), candidate(5, profit=10.0, buy="i", sell="k"), candidate(6, profit=5.0, buy="l", sell="m"),
        *[candidate(10 + k, at=(k + 1) * day, sell=f"s{k}", category="z", score=100.0, risk=0.0) for k in range(3)],
        *[candidate(20 + k, at=(k + 10) * day, sell="b", category=None, score=100.0, risk=0.0) for k in range(2)],
        candidate(30, at=101 * day, category="z", score=100.0, risk=0.0),
    ])
    assert got[1] == (1, True, 56_000, "") and got[2] == (2, False, 0, "marketplace cooldown: a") and got[3] == (3, False, 0, "product cooldown")
    assert got[4] == (4, True, 56_000, "") and got[5] == (5, True, 56_000, "") and got[6] == (6, False, 0, "ranked 6 > top_k=5")
    assert got[10][2] == got[11][2] == 100_000 and got[12] == (1, False, 0, "sizing: below the minimum")  # two fifths of the capital are in category z
    assert got[20] == (1, True, 100_000, "") and got[21] == (1, True, 32_000, "")  # what is left in hand
    assert got[30] == (1, True, 100_000, "")  # positions end after ninety days


def test_halts(spark):
    """Drawdown, loss of a day, rate of wins; the risk check's wait after a loss, and half the size in a streak."""
    loss = [(1, 1, 0, -80_000), (2, 1, 10 * HOUR, -26_000), *[(3, k, k * 24 * HOUR, 10 if k < 4 else -10) for k in range(10)], (4, 1, 0, -100), *[(5, k, k, -100) for k in range(3)], (6, 1, HOUR, -80_000)]
    at = 300 * HOUR
    got = decided(spark, loss, [candidate(1, at), candidate(2, 11 * HOUR, portfolio=2), candidate(3, at, portfolio=3), candidate(4, HOUR // 2, portfolio=4), candidate(5, at, portfolio=5), candidate(6, 0, portfolio=6)])
    assert got[1] == (None, False, 0, "halted: drawdown") and got[2] == (None, False, 0, "halted: daily_loss") and got[3] == (None, False, 0, "halted: win_rate")
    assert got[4] == (1, False, 0, "cooldown") and got[5] == (1, True, 27_983, "") and got[6][1]  # a later loss says nothing


def test_books_match_a_loop(spark):
    rng = random.Random(3)
    trades = [(rng.randrange(4), i, rng.randrange(40) * HOUR * 5, rng.randrange(-900, 900)) for i in range(300)]
    batches = [(p, i, i * HOUR * 17) for p in range(5) for i in range(12)]
    got = {(r["portfolio"], r["batch"]): r.asDict() for r in books(spark.createDataFrame(trades, TRADES), spark.createDataFrame(batches, "portfolio long, batch long, at_us long")).collect()}
    for p, b, at in batches:
        mine = sorted((t for t in trades if t[0] == p and t[2] <= at), key=lambda t: (t[2], t[1]))
        total, peak, streak = 500_000, 500_000, 0
        for t in mine:
            total += t[3]
            peak, streak = max(peak, total), 0 if t[3] >= 0 else streak + 1
        today = sum(-t[3] for t in mine if t[3] < 0 and t[2] // (24 * HOUR) == at // (24 * HOUR))
        want = {"total": total, "peak": peak, "n": len(mine), "wins": sum(t[3] >= 0 for t in mine), "streak": streak, "last_loss": max((t[2] for t in mine if t[3] < 0), default=None), "day_loss": today}
        assert {k: got[p, b][k] for k in want} == want


def test_limits_hold_over_whole_tables(spark):
    """Over all portfolios of sf0.01: open trades, capital in use and the month's wait of a product never break."""
    trades, candidates = trades_and_candidates(spark, "/root/testdata/sf0.01")
    rows = evaluate(trades, candidates, LIMITS).join(candidates.select("portfolio", "opportunity_id", "product_id", "at_us"), ["portfolio", "opportunity_id"]).where("approved").collect()
    of = collections.defaultdict(set)
    for r in rows:
        of[r["portfolio"]].add((r["at_us"], r["opportunity_id"], r["cents"]))
    assert len(rows) > 5000
    for held in of.values():
        for at, _, _ in held:
            now = [c for t, _, c in held if t <= at < t + 90 * 24 * HOUR]
            assert len(now) <= 10 and sum(now) <= 1_000_000


def test_nothing(spark):
    assert decided(spark, [], []) == {} and decided(spark, [(1, 1, 1, 1)], []) == {}
    left_out = [(None, 1, 1, 1, *[None] * 9), (1, 1, None, 2, *[None] * 9), (1, 1, 1, None, *[None] * 9)]
    assert decided(spark, [], left_out) == {}
