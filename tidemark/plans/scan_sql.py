"""The scan as CTEs, for the SQL twins of queries that build on it."""

from __future__ import annotations

from tidemark.functions import formulas as fx
from tidemark.operators.scan import FEE_COLUMNS, HARD_FILTER, MIN_RATING, PROFIT_COLUMNS
from tidemark.sources.tables import AS_OF, DEFAULT_BORDER, SQL

_TAX, _SHIP, _INS = DEFAULT_BORDER
_POS = "({p} * (n + 1))"
_J = "greatest(1, least(CAST(floor({p} * (n + 1)) AS BIGINT), n - 1))"


def _quartile(p: float) -> str:
    j = _J.format(p=p)
    return f"sum(CASE WHEN i = {j} THEN usd * (1 - ({p} * (n + 1) - {j})) WHEN i = {j} + 1 THEN usd * ({p} * (n + 1) - {j}) ELSE 0.0 END)"


_DAILY = "CASE WHEN mid IS NULL THEN greatest(0.1, n / 3.0) ELSE mid * CASE WHEN n >= 10 THEN 1.5 WHEN n >= 5 THEN 1.2 ELSE 1.0 END END"
_named = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())

#: Each step as a CTE on those before it.
STEPS = {
    "dims": SQL["dims"],
    "listings": SQL["listings"],
    "history": SQL["history"],
    "trusted": f"trusted AS MATERIALIZED (SELECT * FROM listings WHERE rating IS NULL OR rating >= {MIN_RATING})",
    "quartiles": f"quartiles AS MATERIALIZED (SELECT product_id, {_quartile(0.25)} AS q1, {_quartile(0.75)} AS q3, max(n) AS n_values FROM (SELECT product_id, usd, row_number() OVER (PARTITION BY product_id ORDER BY usd) AS i, count(*) OVER (PARTITION BY product_id) AS n FROM trusted) GROUP BY product_id)",
    "kept": "kept AS MATERIALIZED (SELECT trusted.* FROM trusted JOIN quartiles USING (product_id) WHERE n_values < 4 OR usd BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))",
    "clean": "clean AS MATERIALIZED (SELECT * FROM kept WHERE product_id IN (SELECT product_id FROM kept GROUP BY product_id HAVING count(DISTINCT mp) >= 2))",
    "ages": f"ages AS MATERIALIZED (SELECT url, min(recorded_at) AS first_at, greatest(1.0, (epoch(TIMESTAMP '{AS_OF}') - epoch(min(recorded_at))) / 86400.0) AS age_days FROM history GROUP BY url)",
    "stable": f"stable AS MATERIALIZED (SELECT *, {fx.STABILITY} AS stability FROM (SELECT url, count(*) AS n_prices, avg(price_usd) AS price_avg, stddev_samp(price_usd) AS price_dev FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY recorded_at DESC, seq DESC) AS rn FROM history) WHERE rn <= 20 GROUP BY url))",
    "depth": f"""estimates AS MATERIALIZED (SELECT product_id, mp, url, unnest([CASE WHEN sales > 0 THEN sales / age_days END, CASE WHEN reviews > 0 THEN reviews / 0.03 / greatest(age_days, 1.0) END]) AS estimate FROM clean JOIN ages USING (url)),
        depth0 AS MATERIALIZED (SELECT product_id, mp, {fx.rounded(_DAILY, 2)} AS daily_sales, {fx.rounded('(' + _DAILY + ') * 30', 1)} AS monthly_sales FROM (SELECT product_id, mp, median(estimate) AS mid, count(DISTINCT url) AS n FROM estimates GROUP BY product_id, mp)),
        depth AS MATERIALIZED (SELECT *, CASE WHEN depth_score >= 70 THEN 'high' WHEN depth_score >= 40 THEN 'medium' ELSE 'low' END AS scalability FROM (SELECT *, {fx.DEPTH_SCORE} AS depth_score FROM depth0))""",
    "stats": f"""stats0 AS MATERIALIZED (SELECT product_id, mp, count(*) AS n, min(usd) AS min_usd, avg(usd) AS avg_usd, max(usd) AS max_usd, sum(sales) AS sales_sum, sum(reviews) AS reviews_sum, avg(CASE WHEN rating > 0 THEN rating END) AS rating_avg FROM clean GROUP BY product_id, mp),
        cheapest AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, mp ORDER BY usd, url) AS rn FROM clean) WHERE rn = 1),
        stats AS MATERIALIZED (SELECT s.*, CASE WHEN n > 1 AND avg_usd > 0 THEN (max_usd - min_usd) / avg_usd ELSE 0.0 END AS price_spread, {fx.VELOCITY} AS velocity, c.url AS buy_url, c.condition, c.rating AS buy_rating, c.reviews AS buy_reviews, c.free_ship AS buy_free, c.scraped_at AS buy_at FROM stats0 s JOIN cheapest c USING (product_id, mp))""",
    "pairs": """pairs AS MATERIALIZED (SELECT b.product_id, r.buy_mp, r.sell_mp, r.label, r.difficulty, b.min_usd AS buy_usd, b.buy_url, b.condition, b.buy_rating, b.buy_reviews, b.buy_free, b.buy_at, s.min_usd, s.price_spread, s.sales_sum, s.reviews_sum, s.velocity
        FROM stats b JOIN routes r ON b.mp = r.buy_mp JOIN stats s ON s.product_id = b.product_id AND s.mp = r.sell_mp WHERE s.min_usd > b.min_usd)""",
    "comp": f"""met AS MATERIALIZED (SELECT p.product_id, p.buy_mp, p.sell_mp, l.usd, l.url, l.rating, l.reviews, l.free_ship, l.scraped_at, row_number() OVER (PARTITION BY p.product_id, p.buy_mp, p.sell_mp ORDER BY l.usd DESC, l.url DESC) AS rn FROM pairs p JOIN clean l ON l.product_id = p.product_id AND l.mp = p.sell_mp AND l.condition = p.condition),
        comp AS MATERIALIZED (SELECT product_id, buy_mp, sell_mp, n, lowest_usd, mean_usd, median_usd, {fx.COMPETITION_SCORE} AS competition_score, {fx.rounded(f'median_usd * {fx.REALISTIC_SHARE}', 2)} AS sell_usd, sell_url, sell_rating, sell_reviews, sell_free, sell_at
            FROM (SELECT *, (highest_usd - lowest_usd) / mean_usd AS spread FROM (SELECT product_id, buy_mp, sell_mp, count(*) AS n, min(usd) AS lowest_usd, avg(usd) AS mean_usd, max(usd) AS highest_usd, median(usd) AS median_usd,
                max(CASE WHEN rn = 1 THEN url END) AS sell_url, max(CASE WHEN rn = 1 THEN rating END) AS sell_rating, max(CASE WHEN rn = 1 THEN reviews END) AS sell_reviews, bool_or(CASE WHEN rn = 1 THEN free_ship ELSE FALSE END) AS sell_free, max(CASE WHEN rn = 1 THEN scraped_at END) AS sell_at FROM met GROUP BY product_id, buy_mp, sell_mp)))""",
    "costs": f"""costs0 AS MATERIALIZED (SELECT p.*, c.* EXCLUDE (product_id, buy_mp, sell_mp), sf.commission, sf.pay_pct, sf.pay_fixed, sf.vat, sf.dom_ship, fx.rate, bf.country <> sf.country AS cross_border,
            coalesce(cb.tax, {_TAX}) AS tax, coalesce(cb.ship, {_SHIP}) AS ship, coalesce(cb.insurance, {_INS}) AS insurance
            FROM pairs p JOIN comp c USING (product_id, buy_mp, sell_mp) JOIN fees sf ON sf.mp = p.sell_mp JOIN fx ON fx.currency = sf.currency JOIN fees bf ON bf.mp = p.buy_mp
            LEFT JOIN cross_border cb ON cb.buy_country = bf.country AND cb.sell_country = sf.country),
        costs1 AS MATERIALIZED (SELECT *, {_named(FEE_COLUMNS)} FROM costs0), costs AS MATERIALIZED (SELECT *, {_named(PROFIT_COLUMNS)} FROM costs1)""",
    "signals": f"""signals AS MATERIALIZED (SELECT f.*, d.daily_sales, d.monthly_sales, d.depth_score, d.scalability, k.n_listings, coalesce(st.stability, 50.0) AS stability, coalesce(a.age_days, 1.0) AS age_days
            FROM (SELECT * FROM costs WHERE {HARD_FILTER}) f JOIN depth d ON d.product_id = f.product_id AND d.mp = f.sell_mp JOIN (SELECT product_id, count(*) AS n_listings FROM clean GROUP BY product_id) k ON k.product_id = f.product_id
            LEFT JOIN stable st ON st.url = f.sell_url LEFT JOIN ages a ON a.url = f.sell_url)""",
    "scored": f"""factors AS MATERIALIZED (SELECT *, {_named(fx.FACTORS)} FROM (SELECT *, {fx.SOFT_PENALTY} AS soft_penalty, {fx.CONFIDENCE_PENALTY} AS confidence_penalty FROM signals)),
        scored AS MATERIALIZED (SELECT *, {fx.opportunity_score()} AS opportunity_score, {fx.RISK_SCORE} AS risk_score, {fx.CONFIDENCE_SCORE} AS confidence_score FROM factors)""",
    "opps": "opps AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY opportunity_score DESC, buy_usd, min_usd, buy_mp, sell_mp) AS rn FROM scored) WHERE rn = 1)",
}


def upto(step: str, select: str) -> str:
    """select over all CTEs up to a step."""
    names = list(STEPS)
    return f"WITH {', '.join(STEPS[n] for n in names[: names.index(step) + 1])} {select}"
