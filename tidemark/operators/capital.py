"""Trades evaluated against portfolios: each approval changes what the candidates after it meet.

A portfolio's closed trades and its batches of candidates lie on one line of time. Windows over that line give the book
at each batch (capital, peak, drawdown, rate of wins, streak, loss of the day), and with it what halts the whole batch and
what the risk check says. Candidates are ranked in their batch; those past the first ``top_k`` are told their rank.
The rest goes through a fold in order of time: open trades, cooldowns, size, concentration, capital in hand. Rows are
shuffled by portfolio and sorted; a task holds the open positions of one portfolio, of which there are
``max_open`` at most, so a portfolio of any length is a stream. It is one task, as every decision waits for the last.

Amounts are whole cents. Ties in rank go to the smaller opportunity_id, then product_id. Candidates of a portfolio without trades meet
the capital to start with. Null confidence, profit, risk or score counts as zero; a null category or marketplace has no
limit and no cooldown. Candidates without a portfolio, time or id are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# The balanced profile's limits, and those of the manager of trades.
@dataclass(frozen=True)
class Limits:
    start_cents: int = 500_000
    top_k: int = 5
    max_active: int = 10
    product_cooldown_s: int = 600
    mp_cooldown_s: int = 120
    hold_s: int = 90 * 86400
    full_size_confidence: float = 0.8
    # Stops of the whole batch.
    stop_drawdown: float = 0.15
    stop_day_loss: float = 0.05
    stop_trades: int = 10
    stop_win_rate: float = 0.5
    # Risk check.
    max_drawdown: float = 0.2
    max_capital_loss: float = 0.15
    max_day_loss_cents: int = 50_000
    streak: int = 3
    streak_factor: float = 0.5
    loss_cooldown_s: int = 3600
    # Size.
    per_trade: float = 0.2
    per_category: float = 0.4
    least_cents: int = 2000
    risk_weight: float = 0.6
    # Concentration.
    max_open: int = 15
    max_product: float = 0.25
    max_mp: float = 0.45
    max_of_category: float = 0.4


BALANCED = Limits()


def books(trades: DataFrame, batches: DataFrame, limits: Limits = BALANCED) -> DataFrame:
    """portfolio, batch, at_us and the book at that moment, for trades(portfolio, trade, at_us, pnl_cents) and batches(portfolio, batch, at_us).

    A trade of a batch's own moment is in its book. ``day`` is the day in UTC.
    """
    line = trades.select("portfolio", "at_us", F.lit(0).alias("kind"), F.col("trade").alias("id"), "pnl_cents")
    line = line.unionByName(batches.select("portfolio", "at_us", F.lit(1).alias("kind"), F.col("batch").alias("id"), F.lit(None).cast("long").alias("pnl_cents")))
    so_far = Window.partitionBy("portfolio").orderBy("at_us", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    today = Window.partitionBy("portfolio", "day").orderBy("at_us", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    pnl = F.col("pnl_cents")
    line = line.withColumn("day", F.floor(F.col("at_us") / 86_400_000_000))
    line = line.withColumn("total", limits.start_cents + F.coalesce(F.sum("pnl_cents").over(so_far), F.lit(0))).withColumn("n", F.count("pnl_cents").over(so_far))
    line = line.withColumns({
        "peak": F.greatest(F.lit(limits.start_cents), F.max("total").over(so_far)),
        "wins": F.count(F.when(pnl >= 0, 1)).over(so_far),
        "streak": F.col("n") - F.coalesce(F.max(F.when(pnl >= 0, F.col("n"))).over(so_far), F.lit(0)),
        "last_loss": F.max(F.when(pnl < 0, F.col("at_us"))).over(so_far),
        "day_loss": -F.coalesce(F.sum(F.when(pnl < 0, pnl)).over(today), F.lit(0)),
    })
    return line.where("kind = 1").select("portfolio", F.col("id").alias("batch"), "at_us", "total", "peak", "n", "wins", "streak", "last_loss", "day_loss")


def _named(tests: dict) -> F.Column:
    return F.concat_ws("; ", *[F.when(F.coalesce(e, F.lit(False)), name) for name, e in tests.items()])


def judged(book: DataFrame, limits: Limits = BALANCED) -> DataFrame:
    """book with stops (what halts a batch), risks (what the risk check refuses for) and factor (of the size)."""
    c = {x: F.col(x) for x in ("total", "peak", "n", "wins", "streak", "day_loss", "last_loss", "at_us")}
    drawdown = (c["peak"] - c["total"]) / c["peak"]
    stops = {
        "drawdown": drawdown >= limits.stop_drawdown,
        "daily_loss": (c["total"] > 0) & (c["day_loss"] >= c["total"] * limits.stop_day_loss),
        "win_rate": (c["n"] >= limits.stop_trades) & (c["wins"] / c["n"] < limits.stop_win_rate),
    }
    risks = {
        "drawdown": drawdown >= limits.max_drawdown,
        "capital_stop_loss": drawdown >= limits.max_capital_loss,
        "daily_loss": c["day_loss"] >= limits.max_day_loss_cents,
        "cooldown": c["at_us"] < c["last_loss"] + limits.loss_cooldown_s * 1_000_000,
    }
    factor = F.when(c["streak"] >= limits.streak, F.lit(limits.streak_factor)).otherwise(F.lit(1.0))
    return book.select("portfolio", "batch", "at_us", "total", _named(stops).alias("stops"), _named(risks).alias("risks"), factor.alias("factor"))


def size_of(row: dict, total: int, used: int, of_category: int, limits: Limits) -> tuple[int, str]:
    """Cents for a candidate, and why there are none."""
    share = max(0.0, min(1.0, row["score"] / 100))
    base = total * limits.per_trade * share
    if base <= 0:
        return 0, "sizing: zero base allocation"
    wanted = base * (1 - max(0.0, min(1.0, row["risk"] / 100)) * limits.risk_weight) * row["factor"]
    most, free = total * limits.per_trade, total - used
    capped = min(wanted, most)
    if row["category"]:
        capped = min(capped, max(0.0, total * limits.per_category - of_category))
    capped = min(capped, free)
    confidence = row["confidence"]
    needed = row["required_cents"] * (1.0 if confidence >= limits.full_size_confidence else 0.5 + confidence / limits.full_size_confidence * 0.5)
    if capped < needed <= free:
        if needed > most:
            return 0, "sizing: above the cap of a trade"
        capped = needed
    if capped < limits.least_cents:
        return 0, "sizing: below the minimum"
    return int(capped + 0.5), ""


class Portfolio:
    """Open positions of one portfolio, and what a candidate meets there."""

    def __init__(self, limits: Limits):
        self.limits, self.held = limits, []

    def decide(self, row: dict) -> tuple[int, str]:
        limits, at = self.limits, row["at_us"]
        self.held = [p for p in self.held if at < p["at_us"] + limits.hold_s * 1_000_000]
        if len(self.held) >= limits.max_active:
            return 0, "max_active_trades"
        if reason := self._cooldown(row):
            return 0, reason
        if row["risks"]:
            return 0, row["risks"]
        total, used = row["total"], sum(p["cents"] for p in self.held)
        cents, reason = size_of(row, total, used, self._of("category", row["category"]), limits)
        if reason:
            return 0, reason
        if reason := self._concentration(row, cents, max(total, 100)):
            return 0, reason
        if cents > total - used:
            return 0, "insufficient capital"
        self.held.append({**row, "cents": cents})
        return cents, ""

    def _of(self, name: str, value) -> int:
        return sum(p["cents"] for p in self.held if p[name] == value)

    def _cooldown(self, row: dict) -> str:
        limits, at = self.limits, row["at_us"]
        if any(p["product_id"] == row["product_id"] and at < p["at_us"] + limits.product_cooldown_s * 1_000_000 for p in self.held):
            return "product cooldown"
        busy = {m for p in self.held if at < p["at_us"] + limits.mp_cooldown_s * 1_000_000 for m in (p["buy_mp"], p["sell_mp"])}
        return next((f"marketplace cooldown: {m}" for m in (row["buy_mp"], row["sell_mp"]) if m is not None and m in busy), "")

    def _concentration(self, row: dict, cents: int, of: int) -> str:
        limits = self.limits
        broken = ["max_open_positions"] if len(self.held) >= limits.max_open else []
        for name, most in (("product_id", limits.max_product), ("sell_mp", limits.max_mp), ("category", limits.max_of_category)):
            if row[name] is not None and (self._of(name, row[name]) + cents) / of > most:
                broken.append(name)
        return "concentration: " + ", ".join(broken) if broken else ""


_IN = ["portfolio", "opportunity_id", "place", "at_us", "product_id", "buy_mp", "sell_mp", "category", "score", "risk", "confidence", "required_cents", "total", "risks", "factor"]
_OUT = "portfolio long, opportunity_id long, place int, cents long, reason string"


def _folded(limits: Limits):
    def fold(batches):
        key, book = None, Portfolio(limits)
        for batch in batches:
            rows = batch.to_pylist()
            cents, reasons = [], []
            for row in rows:
                if row["portfolio"] != key:
                    key, book = row["portfolio"], Portfolio(limits)
                given, reason = book.decide(row)
                cents.append(given)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch["portfolio"], batch["opportunity_id"], batch["place"], pa.array(cents, pa.int64()), pa.array(reasons, pa.string())], ["portfolio", "opportunity_id", "place", "cents", "reason"])

    return fold


def evaluate(trades: DataFrame, candidates: DataFrame, limits: Limits = BALANCED) -> DataFrame:
    """portfolio, opportunity_id, place (null in a halted batch), approved, cents and reason of each candidate.

    trades(portfolio, trade, at_us, pnl_cents); candidates(portfolio, batch, at_us, opportunity_id, product_id, buy_mp,
    sell_mp, category, score, risk, confidence, required_cents, profit), where batch and at_us go together.
    """
    known = candidates.where("portfolio is not null and at_us is not null and opportunity_id is not null")
    known = known.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in ("score", "risk", "confidence", "profit")})
    book = judged(books(trades, known.select("portfolio", "batch", "at_us").distinct(), limits), limits)
    worth = F.floor(F.col("confidence") * F.col("profit") * F.greatest(F.lit(0.01), 1 - F.col("risk") / 100) * 10000 + 0.5)
    ranked = Window.partitionBy("portfolio", "batch", "at_us").orderBy(worth.desc(), "opportunity_id", "product_id")
    both = known.join(book, ["portfolio", "batch", "at_us"]).withColumn("place", F.row_number().over(ranked))
    halted = F.col("stops") != ""
    early = both.where(halted | (F.col("place") > limits.top_k)).select(
        "portfolio", "opportunity_id", F.when(~halted, F.col("place")).alias("place"), F.lit(0).cast("long").alias("cents"),
        F.when(halted, F.concat(F.lit("halted: "), "stops")).otherwise(F.concat(F.lit("ranked "), F.col("place").cast("string"), F.lit(f" > top_k={limits.top_k}"))).alias("reason"),
    )
    folded = both.where(~halted & (F.col("place") <= limits.top_k)).repartition("portfolio").sortWithinPartitions("portfolio", "at_us", "batch", "place")
    decided = folded.select(*_IN).mapInArrow(_folded(limits), _OUT)
    return decided.unionByName(early).withColumn("approved", F.col("reason") == "").select("portfolio", "opportunity_id", "place", "approved", "cents", "reason")
