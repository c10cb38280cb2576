"""Scoring and pricing rules as SQL expressions over named columns, for expr() and selectExpr().

All are built-in functions, so they stay inside code generation.
"""

from __future__ import annotations

import re


def doubles(x: str) -> str:
    """x with its decimal literals as doubles, for Spark, which divides decimals to as little as six places."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", x)


def rounded(x: str, places: int) -> str:
    """x to so many places, halves up; the same on every engine, unlike round() on doubles.

    What lies within a millionth of a half counts as one, so the order of a sum does not matter.
    """
    return f"(floor(({x}) * 1e{places} + 0.500001) / 1e{places})"


def clamp(x: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"least(CAST({high} AS double), greatest(CAST({low} AS double), {x}))"


# Money. Fees of a sale at sell_usd after a buy at buy_usd; the selling side's fees and the border's are columns.
MARKETPLACE_FEE = "sell_usd * commission"
PAYMENT_FEE = "sell_usd * pay_pct + CASE WHEN pay_pct > 0 AND pay_fixed > 0 THEN pay_fixed / rate WHEN pay_pct > 0 THEN 0.30 ELSE 0.0 END"
SELL_TAX = "sell_usd * vat"
DOMESTIC_SHIPPING = "CASE WHEN sell_free THEN 0.0 ELSE dom_ship END"
INTERNATIONAL_SHIPPING = "CASE WHEN cross_border THEN ship ELSE 0.0 END"
IMPORT_TAX = "CASE WHEN cross_border THEN (sell_usd + sell_usd * insurance + ship) * tax ELSE 0.0 END"
TOTAL_FEES = " + ".join(f"({x})" for x in (MARKETPLACE_FEE, PAYMENT_FEE, SELL_TAX, IMPORT_TAX, DOMESTIC_SHIPPING, INTERNATIONAL_SHIPPING))

# Competition among n compatible listings at the selling side, with spread (most - least) / mean.
COMPETITION_SCORE = "CASE WHEN n <= 1 THEN 10.0 ELSE least(100.0, (CASE WHEN n <= 3 THEN 30.0 WHEN n <= 7 THEN 55.0 WHEN n <= 15 THEN 75.0 ELSE 90.0 END) + CASE WHEN spread < 0.05 THEN 10.0 ELSE 0.0 END) END"
REALISTIC_SHARE = 0.97
VELOCITY = rounded("0.4 * least(100.0, reviews_sum * 2.0 / n) + 0.4 * least(100.0, sales_sum * 1.5 / n) + 0.2 * CASE WHEN rating_avg > 0 THEN rating_avg / 5.0 * 100 ELSE 30.0 END", 1)
STABILITY = f"CASE WHEN n_prices < 2 OR price_avg = 0 THEN 50.0 ELSE {rounded(clamp('(1 - price_dev / price_avg / 0.3) * 100'), 1)} END"
DEPTH_SCORE = f"CASE WHEN daily_sales > 0 THEN {rounded('least(100.0, 20 + 25 * log2(daily_sales + 1))', 1)} ELSE 0.0 END"

# The factors of the scores, each from 0 to 100.
MARGIN_N = clamp("margin * 200")
ROI_N = "CASE WHEN roi > 0 THEN least(100.0, 100 * (1 - exp(-2.5 * roi))) ELSE 0.0 END"
PROFIT_N = "CASE WHEN net_profit > 0 THEN least(100.0, 100 * (1 - exp(-3.0 * net_profit / 100))) ELSE 0.0 END"
VOLUME_N = "CASE WHEN n > 0 THEN least(100.0, 20 + 25 * log2(n + 1)) ELSE 0.0 END"


def reputation(rating: str, reviews: str) -> str:
    boost = f"CASE WHEN {reviews} > 0 THEN least(20.0, 5 * log2({reviews} + 1)) ELSE 0.0 END"
    return f"CASE WHEN {rating} > 0 THEN least(100.0, {rating} / 5.0 * 100 * 0.8 + {boost}) WHEN {reviews} > 0 THEN least(60.0, {reviews} * 2.0) ELSE 30.0 END"


REPUTATION = f"(({reputation('buy_rating', 'buy_reviews')}) + ({reputation('sell_rating', 'sell_reviews')})) / 2"
_SALES = "least(100.0, 100 * (1 - exp(-0.01 * sales_sum)))"
_REVIEWS = "CASE WHEN reviews_sum > 0 THEN least(100.0, 100 * (1 - exp(-0.025 * reviews_sum))) ELSE 0.0 END"
_DAILY = "CASE WHEN daily_sales > 0 THEN least(100.0, daily_sales * 20) ELSE 0.0 END"
DEMAND = f"CASE WHEN sales_sum > 0 THEN ({_SALES}) * 0.35 + ({_REVIEWS}) * 0.25 + ({_DAILY}) * 0.20 + depth_score * 0.20 WHEN reviews_sum > 0 THEN ({_REVIEWS}) * 0.40 + ({_DAILY}) * 0.30 + depth_score * 0.30 ELSE ({_DAILY}) * 0.50 + depth_score * 0.50 END"
_RATE = "(sales_sum / age_days + 33.0 * reviews_sum / age_days)"
FREQUENCY = f"CASE WHEN {_RATE} <= 0 THEN 10.0 ELSE least(100.0, 100 * (1 - exp(-0.5 * {_RATE}))) END"
#: Factor to (column, expression); stability counts twice, as its own factor and as volatility.
FACTORS = {"f_margin": MARGIN_N, "f_demand": DEMAND, "f_history": FREQUENCY, "f_volatility": clamp("stability"), "f_volume": VOLUME_N, "f_reputation": REPUTATION, "f_stability": clamp("stability")}
# Weights of the factors by profile, and the limits of the risk classes: prime opportunity, risk and confidence, standard opportunity, risk and confidence, avoid.
PROFILES = {
    "conservative": ((0.15, 0.30, 0.25, 0.10, 0.10, 0.05, 0.05), (70.0, 30.0, 60.0, 40.0, 55.0, 50.0, 25.0)),
    "balanced": ((0.20, 0.25, 0.20, 0.10, 0.10, 0.10, 0.05), (65.0, 35.0, 55.0, 40.0, 55.0, 50.0, 25.0)),
    "aggressive": ((0.30, 0.20, 0.15, 0.05, 0.10, 0.10, 0.10), (55.0, 45.0, 55.0, 35.0, 55.0, 50.0, 25.0)),
    "volume": ((0.10, 0.35, 0.25, 0.10, 0.10, 0.05, 0.05), (65.0, 35.0, 55.0, 30.0, 55.0, 50.0, 15.0)),
}


def opportunity_score(weights: tuple[float, ...] = PROFILES["balanced"][0]) -> str:
    total = " + ".join(f"{f} * {w}" for f, w in zip(FACTORS, weights))
    lifted = f"CASE WHEN f_margin > 70 AND f_demand > 60 THEN least(100.0, ({total}) * 1.08) ELSE {total} END"
    return rounded(clamp(f"({lifted}) * CASE WHEN f_volume < 15 THEN 0.90 ELSE 1.0 END - soft_penalty"), 1)


SOFT_PENALTY = "CASE WHEN margin < 0.05 THEN 15.0 WHEN margin < 0.08 THEN 10.0 ELSE 0.0 END + CASE WHEN buy_rating < 3 OR sell_rating < 3 THEN 5.0 ELSE 0.0 END + CASE WHEN n > 20 THEN 10.0 ELSE 0.0 END"
CONFIDENCE_PENALTY = "CASE WHEN sell_usd / buy_usd > 6 THEN 15.0 ELSE 0.0 END"
_COMPETITION_RISK = "CASE WHEN n >= 10 AND price_spread < 0.10 THEN 85.0 WHEN n >= 10 THEN 65.0 WHEN n >= 5 THEN 45.0 WHEN n >= 2 THEN 25.0 ELSE 80.0 END"
_MARGIN_RISK = "CASE WHEN margin > 0.40 THEN 10.0 WHEN margin > 0.25 THEN 25.0 WHEN margin > 0.15 THEN 40.0 WHEN margin > 0.08 THEN 55.0 WHEN margin > 0.05 THEN 70.0 ELSE 85.0 END"
_BORDER_RISK = "CASE WHEN NOT cross_border THEN 10.0 WHEN difficulty >= 3 THEN 70.0 WHEN difficulty >= 2 THEN 50.0 ELSE 30.0 END"
_RISK = f"(100 - f_volatility) * 0.25 + ({_COMPETITION_RISK}) * 0.20 + greatest(0.0, 100 - f_demand) * 0.20 + ({_MARGIN_RISK}) * 0.15 + ({_BORDER_RISK}) * 0.20"
RISK_SCORE = rounded(clamp(f"{_RISK} + CASE WHEN roi > 2 THEN 10.0 ELSE 0.0 END + CASE WHEN buy_rating < 3 THEN 5.0 ELSE 0.0 END + CASE WHEN sell_rating < 3 THEN 5.0 ELSE 0.0 END"), 1)
_COVERAGE = "(CASE WHEN buy_rating IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN sell_rating IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN sales_sum > 0 THEN 1.5 ELSE 0.0 END + CASE WHEN reviews_sum > 0 THEN 1.5 ELSE 0.0 END + CASE WHEN stability <> 50 THEN 1.0 ELSE 0.0 END + CASE WHEN daily_sales > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN age_days > 1 THEN 0.5 ELSE 0.0 END + CASE WHEN n_listings >= 3 THEN 1.5 ELSE 0.0 END) / 9.0 * 100"
_MEAN = "((" + " + ".join(FACTORS) + ") / 7.0)"
_DEV = "sqrt((" + " + ".join(f"({f} - {_MEAN}) * ({f} - {_MEAN})" for f in FACTORS) + ") / 6.0)"
_ABOVE = "(" + " + ".join(f"CASE WHEN {f} > 40 THEN 1 ELSE 0 END" for f in FACTORS) + ")"
_AGREEMENT = f"least(100.0, CASE WHEN {_ABOVE} >= 5 THEN 90.0 WHEN {_ABOVE} >= 4 THEN 75.0 WHEN {_ABOVE} >= 3 THEN 60.0 ELSE 35.0 END + greatest(0.0, (1 - {_DEV} / greatest({_MEAN}, 1.0)) * 20))"
_RECENCY = "CASE WHEN n_listings >= 8 THEN 95.0 WHEN n_listings >= 5 THEN 80.0 WHEN n_listings >= 3 THEN 65.0 WHEN n_listings >= 2 THEN 50.0 ELSE 25.0 END"
CONFIDENCE_SCORE = rounded(clamp(f"{_COVERAGE} * 0.40 + {_AGREEMENT} * 0.35 + ({_RECENCY}) * 0.25 - confidence_penalty"), 1)


def risk_class(limits: tuple[float, ...], score: str) -> str:
    opp, risk, conf, s_opp, s_risk, s_conf, avoid = limits
    return f"CASE WHEN {score} >= {opp} AND risk_score <= {risk} AND confidence_score >= {conf} THEN 'PRIME' WHEN {score} <= {avoid} THEN 'AVOID' WHEN {score} >= {s_opp} AND risk_score <= {s_risk} AND confidence_score >= {s_conf} THEN 'STANDARD' WHEN {score} >= {s_opp} AND risk_score > {s_risk} THEN 'SPECULATIVE' ELSE 'AVOID' END"


LEGACY_SCORE = rounded(clamp("(CASE WHEN net_profit > 0 THEN least(100.0, net_profit / 200 * 100) ELSE 0.0 END) * 0.20 + (CASE WHEN roi > 0 THEN least(100.0, roi * 100) ELSE 0.0 END) * 0.15 + (CASE WHEN margin > 0 THEN least(100.0, margin * 200) ELSE 0.0 END) * 0.10 + velocity * 0.15 + greatest(0.0, 100 - competition_score) * 0.10 + stability * 0.10 + depth_score * 0.10 + 50 * 0.10"), 1)

# Trend of a product from its snapshots.
VELOCITY_RATE = "CASE WHEN coalesce({past}, 0) <= 0 THEN CAST(greatest({now}, 0) AS double) ELSE ({now} - {past}) * 1.0 / {past} END"
TREND_SCORE = rounded(clamp("least(100.0, greatest(0.0, 50 + 30 * tanh(velocity_7d))) * 0.40 + least(100.0, marketplace_count * 33.3) * 0.20 + least(100.0, log10(greatest(listing_count, 1)) * 50) * 0.20 + least(100.0, log10(greatest(total_reviews + total_sales * 2, 1)) * 30) * 0.20 + CASE WHEN is_new THEN 10.0 ELSE 0.0 END"), 1)
TREND_LABEL = "CASE WHEN is_new AND listing_count >= 3 THEN 'emerging' WHEN velocity_7d > 1 THEN 'surging' WHEN velocity_7d > 0.5 THEN 'rising' WHEN velocity_7d > 0 THEN 'growing' WHEN velocity_7d < -0.3 THEN 'declining' ELSE 'stable' END"
