"""Verdicts of the resolver's matchers as expressions that both engines read.

A matcher accepts with a confidence above 0, rejects with -1 and passes with NULL; one rejection makes the whole 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of model ids, in lower case.
MODEL_PATTERNS = (
    r"(iphone\s*\d+\s*(?:pro\s*max|pro|plus|e|mini)?)",
    r"(galaxy\s*(?:s|a|z|tab|watch|buds)\s*\d+\s*(?:ultra|plus|fe|pro|lite|fold|flip)?(?:\s*\d+)?)",
    r"(pixel\s*\d+\s*(?:pro\s*xl|pro\s*fold|pro|a)?)",
    r"(redmi\s*(?:note\s*)?\d+\s*(?:pro\s*max|pro\s*plus|pro|s|c|a)?)",
    r"([a-z]{2,3}[\-]?\d{3,4}[a-z]*\d*)",
    r"(airpods\s*(?:pro|max)?\s*\d*)",
    r"(ddr\d\s*\d+(?:mhz)?\s*\d+\s*gb)",
    r"(\d+\s*(?:gb|tb))\b",
    r"\b([a-z]{1,3}\d{2,4}[a-z]?\d*)\b",
)
# Sizes of storage in order of search, words of bundles, other names of brands.
STORAGE = ("64gb", "128gb", "256gb", "512gb", "1tb", "2tb")
BUNDLES = ("bundle", "combo", "kit", "pack", "set")
BRAND_ALIASES = (("ml", "mercadolibre"), ("lg", "lg electronics"), ("hp", "hewlett-packard"))
# Words that no title may hold in strict matching.
STRICT_REJECTS = (
    "bundle", "kit", "pack", "combo", "set", "lote", "compatible", "for ", "para ", "funda", "case", "cover", "cable", "cargador", "charger", "protector", "strap", "correa", "band", "mount", "soporte",
    "adapter", "adaptador", "holder", "bracket", "film", "mica", "glass", "vidrio", "skin", "pouch", "estuche", "bolsa", "replacement", "repuesto", "reemplazo", "tip", "punta",
)


def model_ids(title: Column) -> Column:
    """All model ids of a title in lower case, without spaces, of two or more characters."""
    found = F.flatten(F.array(*[F.regexp_extract_all(title, F.lit(p), F.lit(1)) for p in MODEL_PATTERNS]))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))), lambda x: F.length(x) >= 2)


def model_ids_sql(title: str) -> str:
    found = ", ".join(f"regexp_extract_all({title}, '{p}', 1)" for p in MODEL_PATTERNS)
    return f"list_filter(list_distinct(list_transform(flatten([{found}]), lambda x: regexp_replace(x, '\\s+', '', 'g'))), lambda x: length(x) >= 2)"


def any_word(title: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"instr({title}, '{w}') > 0" for w in words) + ")"


def storage(title: str) -> str:
    joined = f"replace(replace({title}, ' gb', 'gb'), ' tb', 'tb')"
    return "CASE " + " ".join(f"WHEN instr({joined}, '{s}') > 0 THEN '{s}'" for s in STORAGE) + " END"


def brand_key(brand: str) -> str:
    """The name under which all names of a brand compare equal."""
    clean = f"lower(trim(coalesce({brand}, '')))"
    return f"CASE {clean} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in BRAND_ALIASES) + f" ELSE {clean} END"


#: Over l_brand, c_brand (clean), l_key, c_key; n_l, n_c, n_both model ids; l_storage, c_storage; l_bundle, c_bundle.
BRAND = "CASE WHEN l_brand = '' OR c_brand = '' THEN NULL WHEN l_brand = c_brand THEN 6e-1 WHEN l_key = c_key THEN 55e-2 ELSE -1e0 END"
MODEL = "CASE WHEN n_l = 0 OR n_c = 0 THEN NULL WHEN n_both > 0 THEN least(9e-1, 5e-1 + 1e-1 * n_both) ELSE -1e0 END"
ATTRIBUTE = "CASE WHEN l_storage <> c_storage THEN -1e0 WHEN l_bundle <> c_bundle THEN -1e0 WHEN l_storage = c_storage THEN 7e-1 END"
PARTS = ("brand_conf", "model_conf", "attr_conf", "sem_conf")


def semantic(threshold: float) -> str:
    return f"CASE WHEN sim >= {threshold:e} THEN 5e-1 + 4e-1 * (sim - {threshold:e}) / (1e0 - {threshold:e}) WHEN sim >= {threshold:e} * 85e-2 THEN NULL ELSE -1e0 END"


#: The mean of what accepts; 0 after a rejection; half the similarity where nothing accepts.
COMPOSITE = (
    f"CASE WHEN least({', '.join(f'coalesce({p}, 0e0)' for p in PARTS)}) < 0 THEN 0e0 WHEN coalesce({', '.join(PARTS)}) IS NULL THEN sim * 5e-1 "
    f"ELSE ({' + '.join(f'coalesce({p}, 0e0)' for p in PARTS)}) / ({' + '.join(f'CASE WHEN {p} IS NULL THEN 0 ELSE 1 END' for p in PARTS)}) END"
)
