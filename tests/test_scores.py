"""Scores whose unrounded value lies next to a half: the digits that a decimal division cuts off decide them."""

from tidemark.functions import formulas as fx
from tidemark.operators import scan

#: A pair at 60 times sf0.1; 7.0 of 9.0 points of coverage, and its confidence is 89.84999594.
PAIR = {
    "sell_usd": 2003.39, "buy_usd": 712.04, "net_profit": 163.44, "roi": 0.2295, "margin": 0.0816, "n": 1, "price_spread": 1.5715708813553158, "cross_border": True, "difficulty": 2,
    "buy_rating": 4.7, "buy_reviews": 110, "sell_rating": None, "sell_reviews": 10, "sales_sum": 16, "reviews_sum": 74, "daily_sales": 0.17, "depth_score": 25.7, "stability": 50.0, "age_days": 358.0, "n_listings": 18,
}
TYPES = "sell_usd double, buy_usd double, net_profit double, roi double, margin double, n long, price_spread double, cross_border boolean, difficulty int, buy_rating double, buy_reviews long, sell_rating double, sell_reviews long, sales_sum long, reviews_sum long, daily_sales double, depth_score double, stability double, age_days double, n_listings long"


def test_confidence_next_to_a_half(spark):
    got = scan.scored(spark.createDataFrame([tuple(PAIR.values())], TYPES)).first()
    factors = [got[f] for f in fx.FACTORS]
    mean = sum(factors) / 7
    dev = (sum((f - mean) ** 2 for f in factors) / 6) ** 0.5
    assert sum(f > 40 for f in factors) == 5
    whole = (1 + 1.5 + 1.5 + 1 + 0.5 + 1.5) / 9 * 100 * 0.40 + min(100, 90 + max(0, (1 - dev / mean) * 20)) * 0.35 + 95 * 0.25
    assert abs(whole - 89.84999594) < 1e-8
    assert got["confidence_score"] == 89.8


def test_literals_of_decimals_only():
    assert fx.doubles("a.b * 0.40 + 9.0 / x1.5e0 - 1e1 + 5e-1 + 2.5e0 + 3") == "a.b * 0.40D + 9.0D / x1.5e0 - 1e1 + 5e-1 + 2.5e0 + 3"
