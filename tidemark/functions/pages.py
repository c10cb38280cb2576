"""Pages of marketplaces: result cards, next page, sub-categories, blocked responses, as expressions that both engines read.

A card is the piece of a page from its opening tag to the next card's; patterns avoid backslashes and look-around.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Signs of a challenge and of a firewall, in either case.
CAPTCHA = ("recaptcha", "hcaptcha", "captcha[_-]?challenge", "g-recaptcha", "cf-challenge", "px-captcha")
FIREWALL = ("access[ \t\n]+denied", "bot[ \t\n]+detected", "automated[ \t\n]+access", "suspicious[ \t\n]+activity", "robot[ \t\n]+check", "pardon[ \t\n]+our[ \t\n]+interruption", "no[ \t\n]+pudimos[ \t\n]+confirmar")
# Parts of links that lead to no sub-category.
NO_CATEGORY = ("page=", "_Desde_", "sort=", "order=", "#", "javascript:", "signin", "login", "cart", "wishlist", "account", "help")


@dataclass(frozen=True)
class Cards:
    """How one marketplace writes a result: the opening of a card, and expressions over ``card`` (its piece)."""

    opening: str
    url: str
    title: str
    price: str
    currency: str
    condition: str
    rating: str
    reviews: str
    free_shipping: str
    skip: str
    next_page: str


def find(pattern: str, text: str = "card") -> str:
    return f"regexp_extract({text}, '{pattern}', 1)"


def strip(text: str) -> str:
    """Without tags and outer space."""
    return f"trim(regexp_replace({text}, '<[^>]*>', ''{{g}}))"


def only(text: str, kept: str) -> str:
    return f"regexp_replace({text}, '[^{kept}]', ''{{g}})"


def number(text: str, kind: str = "DOUBLE") -> str:
    return f"TRY_CAST({text} AS {kind})"


def _inner(css: str, end: str) -> str:
    return strip(find(f'(?s)class="[^"]*{css}[^"]*"[^>]*>(.*?)</{end}>'))


_EBAY_PRICE = _inner("s-item__price", "(?:div|li)")
_EBAY_STATE = f"lower({_inner('SECONDARY_INFO', 'span')})"
_ML_STARS = "regexp_extract(card, 'class=\"([^\"]*seller-status[^\"]*)\"', 1)"
_ML_WHOLE = only(find('(?:money-amount__fraction|price__fraction)[^>]*>([^<]*)<'), "0-9")
_ML_CENTS = only(find('money-amount__cents[^>]*>([^<]*)<'), "0-9")
_AMAZON_LABEL = "regexp_extract(card, 'aria-label=\"([^\"]*star[^\"]*)\"', 1)"

CARDS = {
    "ebay": Cards(
        opening='<li class="s-item ',
        url=find('href="([^"]*itm/[^"]*)"'),
        title=_inner("s-item__title", "(?:div|h3)"),
        price=number(only(f"regexp_replace({_EBAY_PRICE}, ' (to|a) .*', '')", "0-9.")),
        currency=f"CASE WHEN instr({_EBAY_PRICE}, 'EUR') > 0 OR instr({_EBAY_PRICE}, '€') > 0 THEN 'EUR' WHEN instr({_EBAY_PRICE}, 'GBP') > 0 OR instr({_EBAY_PRICE}, '£') > 0 THEN 'GBP' ELSE 'USD' END",
        condition=f"CASE WHEN instr({_EBAY_STATE}, 'refurbished') > 0 THEN 'refurbished' WHEN instr({_EBAY_STATE}, 'used') > 0 OR instr({_EBAY_STATE}, 'pre-owned') > 0 THEN 'used' ELSE 'new' END",
        rating=f"coalesce({number(find('s-item__seller-info-text[^>]*>[^<]*?([0-9.]+)%'))} / 20, 0e0)",
        reviews=f"coalesce({number(find('^([0-9]+)', only(_inner('s-item__reviews-count', 'span'), '0-9')), 'BIGINT')}, 0)",
        free_shipping=f"lower({_inner('s-item__(?:shipping|freeXDays)', 'span')}) LIKE '%free%' OR lower({_inner('s-item__(?:shipping|freeXDays)', 'span')}) LIKE '%gratis%'",
        skip="lower(title) LIKE 'shop on ebay%'",
        next_page=find('<a [^>]*pagination__next[^>]*href="([^"]*)"', "html"),
    ),
    "mercadolibre_mx": Cards(
        opening='<li class="ui-search-layout__item',
        url=find('<a [^>]*ui-search-(?:link|item__group__element)[^>]*href="([^"]*)"'),
        title=_inner("ui-search-item__title", "(?:h2|h3|span)"),
        price=number(f"concat({_ML_WHOLE}, '.', CASE WHEN {_ML_CENTS} = '' THEN '0' ELSE {_ML_CENTS} END)"),
        currency="'MXN'",
        condition="CASE WHEN lower(card) LIKE '%usado%' OR lower(card) LIKE '%used%' THEN 'used' ELSE 'new' END",
        rating=f"CASE WHEN {_ML_STARS} LIKE '%excellent%' OR {_ML_STARS} LIKE '%5%' THEN 5e0 WHEN {_ML_STARS} LIKE '%good%' OR {_ML_STARS} LIKE '%4%' THEN 4e0 WHEN {_ML_STARS} LIKE '%regular%' OR {_ML_STARS} LIKE '%3%' THEN 3e0 ELSE 0e0 END",
        reviews=f"coalesce({number(find('([0-9]+)', only(_inner('ui-search-reviews__amount', 'span'), '0-9')), 'BIGINT')}, 0)",
        free_shipping="lower(card) LIKE '%gratis%'",
        skip="FALSE",
        next_page=find('<a [^>]*pagination__link[^>]*title="Siguiente"[^>]*href="([^"]*)"', "html"),
    ),
    "amazon_us": Cards(
        opening='<div data-component-type="s-search-result"',
        url="CASE WHEN {link} <> '' THEN concat('https://www.amazon.com', {link}) WHEN {asin} <> '' THEN concat('https://www.amazon.com/dp/', {asin}) ELSE '' END".replace("{link}", find('<h2[^>]*><a [^>]*href="([^"]*)"')).replace("{asin}", find('data-asin="([^"]*)"')),
        title=_inner("(?:a-text-normal|a-size-base-plus)", "(?:span|a)"),
        price=number(f"CASE WHEN {find('a-offscreen[^>]*>([^<]*)<')} <> '' THEN {only(find('a-offscreen[^>]*>([^<]*)<'), '0-9.')} ELSE concat({only(find('a-price-whole[^>]*>([^<]*)<'), '0-9')}, '.', {only(find('a-price-fraction[^>]*>([^<]*)<'), '0-9')}) END"),
        currency="'USD'",
        condition="'new'",
        rating=f"coalesce({number(find('([0-9.]+)', _AMAZON_LABEL))}, 0e0)",
        reviews=f"coalesce({number(only(find('s-underline-text[^>]*>([^<]*)<'), '0-9'), 'BIGINT')}, 0)",
        free_shipping="card LIKE '%FREE%' OR lower(card) LIKE '%envío gratis%'",
        skip=f"card LIKE '%sp-sponsored-result%' OR {find('data-asin="([^"]*)"')} = ''",
        next_page=find('<a [^>]*class="s-pagination-item s-pagination-next[^"]*"[^>]*href="([^"]*)"', "html"),
    ),
}
FIELDS = ("url", "title", "price", "currency", "condition", "rating", "reviews", "free_shipping")


def field(marketplace: str, name: str, g: str) -> str:
    """An expression of a marketplace; g is what makes an engine replace all matches."""
    return getattr(CARDS[marketplace], name).replace("{g}", g)


def blocked_sql(status: str, body: str, rlike) -> str:
    """Kind of block, or NULL; rlike(text, pattern) is the engine's test."""
    head = f"substring({body}, 1, 5000)"
    test = lambda signs: rlike(head, "(?i)" + "|".join(signs))
    return (
        f"CASE WHEN {status} = 429 THEN 'rate_limit' WHEN {status} = 403 THEN 'ip_ban' WHEN {status} = 503 AND length({body}) < 2000 THEN 'waf' "
        f"WHEN {status} >= 400 THEN NULL WHEN {test(CAPTCHA)} THEN 'captcha' WHEN {test(FIREWALL)} THEN 'waf' END"
    )


#: Over href and url: the absolute link, its form without query and closing slashes, and the slug of its last two segments.
LINK = {
    "host": "regexp_extract(url, '^(https?://[^/?]+)', 1)",
    "target": "CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN concat(host, href) END",
    "clean": "regexp_replace(regexp_extract(target, '^([^?]*)', 1), '/+$', '')",
    "path": "regexp_extract(clean, '^https?://[^/]+/(.*)$', 1)",
    "slug": "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '([^/]+/+[^/]+)$', 1) ELSE path END, '/+', '-'{g})), '[^a-z0-9-]', ''{g}), '-+', '-'{g}), '^-|-$', ''{g})",
}


# The keys that make an object an item, and how deep objects are searched.
ITEM_KEYS, DEPTH = ("productId", "itemId"), 10


def _items(node: dict | list, depth: int = 0) -> Iterator[dict]:
    """Items below a node: an item in a list is not searched for others, one in an object is; lists in lists are passed over."""
    in_object = isinstance(node, dict)
    for child in node.values() if in_object else node:
        is_item = isinstance(child, dict) and any(k in child for k in ITEM_KEYS)
        deeper = depth < DEPTH and isinstance(child, (dict, list) if in_object else dict)
        if is_item and (deeper or not in_object):
            yield child
        if deeper and (in_object or not is_item):
            yield from _items(child, depth + 1)


@F.pandas_udf(ArrayType(StringType()))
def find_items(texts: pd.Series) -> pd.Series:
    """All items of each JSON text, as JSON, in order; null and broken texts have none."""

    def of(text: str | None) -> list[str]:
        try:
            data = json.loads(text) if text else None
        except ValueError:
            return []
        # The text itself is searched as the one child of an object.
        return [json.dumps(item) for item in _items({"": data}, -1)] if isinstance(data, (dict, list)) else []

    return texts.map(of)
