"""When two titles name variants of one product: features of a title, taken once per row, and a predicate over two rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import accessory_sql

# Patterns of model identifiers in order; the first that matches counts, in either case.
MODEL_PATTERNS = (
    r"(iphone\s*\d+\s*(?:pro\s*max|pro|plus|e|mini)?)",
    r"(galaxy\s*(?:s|a|z|tab|watch|buds)\s*\d+\s*(?:ultra|plus|fe|pro|lite|fold|flip)?(?:\s*\d+)?)",
    r"(pixel\s*\d+\s*(?:pro\s*xl|pro\s*fold|pro|a)?)",
    r"(redmi\s*(?:note\s*)?\d+\s*(?:pro\s*max|pro\s*plus|pro|s|c|a)?)",
    r"(poco\s*(?:m|x|f|c|pad)\s*\d*\s*(?:pro|gt)?)",
    r"(watch\s*(?:series\s*\d+|ultra\s*\d*|se\s*\d*)\b)",
    r"(freebuds\s*\w+\s*\d*)",
    r"(airpods\s*(?:pro|max)?\s*\d*)",
    r"([a-z]{2,3}-?\d{3,4}[a-z]*\d*)",
    r"(ddr\d\s*\d+\s*gb)",
    r"(gopro\s*hero\s*\d*\s*(?:black|silver|white|lit)?)",
    r"((?:blackwidow|kraken|deathadder|viper|huntsman|basilisk|ornata)\s*v\d+\s*(?:pro|lite|mini|te|75%|tkl)?)",
    r"((?:tuf|rog|ally|thinkpad|latitude|xps)\s*\w*\s*\w*)",
    r"(tab\s*(?:s|a)?\s*\d+\s*(?:fe|lite|ultra|plus)?)",
)
# Words with numbers, numbers after words of a model, and the device a part is for.
NUMBER_PATTERN = r"\b([a-z]+[\-]?\d{2,}[a-z0-9]*)\b"
AFTER_WORD_PATTERN = r"\b(?:edge|hero|mini|v|series|pro|wh|wf|xm|tank|tab|redmi|note|pad|watch|buds|band|ecotank|pixma|envy|deskjet|laserjet|l|gt|rtx|rx|ryzen|core\s*i)\s*(\d{2,}[a-z0-9]*)\b"
TARGET_PATTERN = r"(?:para\s+(?:el\s+)?)(ipad|imac|iphone|macbook|mac\b)"
# Words that tell variants apart.
STORAGE = ("64gb", "128gb", "256gb", "512gb", "1tb", "2tb")
CAPACITY = ("5000mah", "10000mah", "20000mah", "25000mah", "30000mah", "40w", "65w", "100w", "140w")
BUNDLE = ("bundle", "combo", "kit", "pack", "set", "con funda", "con case")
REFURBISHED = ("reacond", "refurbish", "renewed", "remanufactur", "renovado")
DISC = ("unidad de disco", "disc edition", "con disco", "con lector")
DIGITAL = ("edición digital", "edicion digital", "digital edition")
# Words that say nothing about which product a title names.
TITLE_STOP_WORDS = tuple("de para con en el la los las un una del al y o a e the for with and in color negro blanco gris azul rojo black white grey blue red green pink silver gold".split())


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _first(x: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{w}'" for w in words) + " END"


#: Features that both engines read as they stand, of a title in lower case, low.
SHARED = {
    "refurbished": _any("low", REFURBISHED),
    "accessory": accessory_sql("low"),
    "storage": _first("replace(replace(low, ' gb', 'gb'), ' tb', 'tb')", STORAGE),
    "capacity": _first("replace(low, ' ', '')", CAPACITY),
    "disc": _any("low", DISC),
    "digital": f"({_any('low', DIGITAL)} AND NOT {_any('low', DISC)})",
    "bundle": _any("low", BUNDLE),
}


def model_id(title: Column) -> Column:
    """The first pattern's match, in lower case with single spaces."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(title, f"(?i){p}", 1), F.lit("")) for p in MODEL_PATTERNS])
    return F.regexp_replace(F.lower(F.trim(found)), r"\s+", " ")


def model_numbers(low: Column) -> Column:
    plain = F.transform(F.regexp_extract_all(low, F.lit(NUMBER_PATTERN), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit("")))
    return F.array_union(plain, F.regexp_extract_all(low, F.lit(AFTER_WORD_PATTERN), F.lit(1)))


def features(title: Column) -> dict[str, Column]:
    low = F.lower(title)
    words = F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0))), lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOP_WORDS))
    return {
        "low": low,
        "model": model_id(title),
        "numbers": model_numbers(low),
        "targets": F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(TARGET_PATTERN), F.lit(1)))),
        "words": words,
    }


def features_sql(title: str) -> str:
    """The features as columns for DuckDB, over a title."""
    quote = lambda p: p.replace("'", "''")
    model = ", ".join(f"nullif(regexp_extract({title}, '{quote(p)}', 1, 'i'), '')" for p in MODEL_PATTERNS)
    stop = ", ".join(f"'{w}'" for w in TITLE_STOP_WORDS)
    return f"""lower({title}) AS low, regexp_replace(lower(trim(coalesce({model}))), '\\s+', ' ', 'g') AS model,
list_distinct(list_concat(list_transform(regexp_extract_all(lower({title}), '{NUMBER_PATTERN}', 1), lambda x: replace(x, '-', '')), regexp_extract_all(lower({title}), '{AFTER_WORD_PATTERN}', 1))) AS numbers,
list_sort(list_distinct(regexp_extract_all(lower({title}), '{TARGET_PATTERN}', 1))) AS targets,
list_filter(list_distinct(regexp_extract_all(lower({title}), '\\S+')), lambda t: length(t) > 1 AND t NOT IN ({stop})) AS words"""


#: Do a buy b and a sell s name compatible variants? Over their features, conditions and the number of model numbers of each and of both.
COMPATIBLE = (
    "b_condition = s_condition AND b_refurbished = s_refurbished AND b_accessory = s_accessory AND (b_n_numbers = 0 OR s_n_numbers = 0 OR n_numbers > 0)"
    " AND coalesce(b_storage = s_storage, TRUE) AND coalesce(b_capacity = s_capacity, TRUE) AND b_disc = s_disc AND b_digital = s_digital AND b_bundle = s_bundle"
    " AND (b_n_targets = 0 OR s_n_targets = 0 OR b_targets = s_targets)"
)
#: Do two titles name one product? By model where both have one, else by a quarter of common words.
SAME_TITLE = (
    "CASE WHEN b_low IS NULL OR s_low IS NULL OR b_low = '' OR s_low = '' THEN TRUE WHEN b_model IS NOT NULL AND s_model IS NOT NULL THEN b_model = s_model"
    " WHEN b_model IS NOT NULL OR s_model IS NOT NULL THEN FALSE WHEN b_n_words = 0 OR s_n_words = 0 THEN TRUE ELSE n_words * 1e0 / (b_n_words + s_n_words - n_words) >= 25e-2 END"
)


def with_features(rows, title: str):
    """rows with the features of a title column."""
    return rows.withColumns(features(F.col(title))).withColumns({name: F.expr(e) for name, e in SHARED.items()})


def judged(pairs):
    """Pairs of rows with features, as columns b_ and s_, with compatible and same_title."""
    sizes = {f"{side}_n_{c}": F.size(f"{side}_{c}") for side in "bs" for c in ("numbers", "targets", "words")}
    both = {f"n_{c}": F.size(F.array_intersect(f"b_{c}", f"s_{c}")) for c in ("numbers", "words")}
    return pairs.withColumns(sizes | both).withColumns({"compatible": F.expr(COMPATIBLE), "same_title": F.expr(SAME_TITLE)})


def sides(rows, on: list[str]):
    """rows under the names of a buy and of a sell."""
    return tuple(rows.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in on]) for side in "bs")


def told(title: str, condition: str) -> Column:
    """All features of a title column, and a condition, as one struct."""
    shared = {name: F.expr(re.sub(r"\blow\b", f"lower({title})", e)) for name, e in SHARED.items()}
    return F.struct(F.col(condition).alias("condition"), *[e.alias(name) for name, e in (features(F.col(title)) | shared).items()])


def fits_within(buy: str, sell: str) -> str:
    """Both predicates over two structs of features, as one expression for use inside a lambda."""
    both = f"({COMPATIBLE}) AND ({SAME_TITLE})"
    for pattern, said in ((r"\bb_n_(\w+)", rf"size({buy}.\1)"), (r"\bs_n_(\w+)", rf"size({sell}.\1)"), (r"\bn_(\w+)", rf"size(array_intersect({buy}.\1, {sell}.\1))"), (r"\bb_(\w+)", rf"{buy}.\1"), (r"\bs_(\w+)", rf"{sell}.\1")):
        both = re.sub(pattern, said, both)
    return f"coalesce({both}, FALSE)"
