"""Search terms and their variants: synonyms, products of a brand, modifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a term and what may stand in their place.
SYNONYMS = {
    "usb hub": ["usb-c hub", "type-c hub", "multiport usb hub", "docking station usb"],
    "usb-c": ["type-c", "usb type c", "thunderbolt"],
    "auriculares": ["audifonos", "earbuds", "headphones", "earphones"],
    "audifonos": ["auriculares", "earbuds", "headphones"],
    "parlante": ["bocina", "speaker", "altavoz"],
    "bocina": ["parlante", "speaker", "altavoz"],
    "cargador": ["charger", "cargador rapido", "fast charger"],
    "funda": ["case", "protector", "cover", "carcasa"],
    "teclado": ["keyboard", "teclado mecanico", "mechanical keyboard"],
    "mouse": ["raton", "mouse inalambrico", "wireless mouse"],
    "monitor": ["pantalla", "display", "screen"],
    "notebook": ["laptop", "portatil", "ultrabook"],
    "laptop": ["notebook", "portatil", "ultrabook"],
    "tablet": ["tableta", "ipad", "tab"],
    "smartwatch": ["reloj inteligente", "smart watch", "fitness tracker"],
    "drone": ["dron", "quadcopter", "mini drone"],
    "camara": ["camera", "camara digital", "cam"],
    "ssd": ["disco solido", "solid state drive", "nvme"],
    "disco duro": ["hard drive", "hdd", "disco externo"],
    "router": ["access point", "mesh wifi", "repetidor wifi"],
    "power bank": ["bateria portatil", "cargador portatil", "powerbank"],
    "protector pantalla": ["screen protector", "vidrio templado", "tempered glass"],
    "control": ["gamepad", "joystick", "mando"],
    "consola": ["console", "gaming console"],
    "memoria": ["ram", "memory", "memoria ram"],
    "tarjeta grafica": ["gpu", "graphics card", "video card"],
    "impresora": ["printer", "impresora laser", "impresora tinta"],
    "cable": ["cable usb", "cable hdmi", "cable lightning", "cable tipo c"],
}
# What a brand sells.
BRANDS = {
    "apple": ["airpods", "iphone", "ipad", "macbook", "apple watch", "airtag"],
    "samsung": ["galaxy", "galaxy buds", "galaxy watch", "galaxy tab"],
    "sony": ["wh-1000xm5", "wh-1000xm4", "wf-1000xm5", "playstation", "ps5"],
    "xiaomi": ["redmi", "poco", "mi band", "mi watch"],
    "jbl": ["flip", "charge", "tune", "go", "xtreme", "pulse"],
    "logitech": ["g pro", "mx master", "g502", "g305", "brio"],
    "razer": ["deathadder", "viper", "blackwidow", "kraken"],
    "nintendo": ["switch", "switch oled", "joy-con", "pro controller"],
    "bose": ["quietcomfort", "soundlink", "sport earbuds"],
    "anker": ["soundcore", "powercore", "nano", "735 charger"],
    "marshall": ["major", "minor", "emberton", "stanmore"],
    "hyperx": ["cloud", "alloy", "pulsefire"],
    "steelseries": ["arctis", "rival", "apex"],
    "corsair": ["k70", "void", "hs80", "vengeance"],
    "tp-link": ["deco", "archer", "tapo"],
    "google": ["pixel", "chromecast", "nest"],
    "huawei": ["freebuds", "watch gt", "matepad"],
    "lenovo": ["thinkpad", "ideapad", "legion", "tab"],
    "asus": ["rog", "zenbook", "vivobook", "tuf"],
    "dji": ["mini", "mavic", "air", "osmo"],
}
# Words that narrow any term.
MODIFIERS = ["inalambrico", "bluetooth", "wifi", "pro", "mini", "portatil", "profesional", "gamer", "gaming"]


def _table(words: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(key).alias("key"), F.array(*map(F.lit, of)).alias("words")) for key, of in words.items()])


def expanded(term: Column, most: int = 8) -> Column:
    """The term in lower case and at most ``most`` variants, in this order: synonyms, products of its brand, modifiers.

    A map over literal arrays; null gives null.
    """
    low = F.lower(F.trim(term))
    synonyms = F.flatten(F.transform(F.filter(_table(SYNONYMS), lambda d: F.contains(low, d["key"])), lambda d: F.transform(d["words"], lambda w: F.replace(low, d["key"], w))))
    of_brand = F.filter(_table(BRANDS), lambda d: (low == d["key"]) | F.startswith(low, F.concat(d["key"], F.lit(" "))))
    products = F.flatten(F.transform(of_brand, lambda d: F.transform(d["words"], lambda w: F.concat_ws(" ", d["key"], w))))
    modifiers = F.array(*map(F.lit, MODIFIERS))
    named = F.exists(F.array(*map(F.lit, BRANDS)), lambda b: F.contains(low, b))
    narrowed = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("word")) for i, m in enumerate(MODIFIERS)]), lambda m: named & (m["i"] < 3))
    narrow = F.concat(F.transform(narrowed, lambda m: m["word"]), F.filter(modifiers, lambda m: ~F.contains(low, m)))
    found = F.concat(F.array(low), synonyms, products, F.transform(narrow, lambda m: F.concat_ws(" ", low, m)))
    return F.when(low.isNotNull(), F.slice(F.array_distinct(found), 1, most + 1))


def expansion_sql(terms: str, most: int = 8) -> str:
    """CTEs on a relation of terms (low) that end in ``expansion`` (low, variant, place), built of joins with rows of words."""
    rows = lambda words: ", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate((k, w) for k, of in words.items() for w in of))
    return f"""synonyms(i, word, other) AS (VALUES {rows(SYNONYMS)}), brands(i, word, other) AS (VALUES {rows(BRANDS)}), modifiers(i, other) AS (VALUES {', '.join(f"({i}, '{m}')" for i, m in enumerate(MODIFIERS))}),
variants AS (SELECT low, low AS variant, 0 AS step, 0 AS i FROM {terms} UNION ALL SELECT low, replace(low, word, other), 1, i FROM {terms} JOIN synonyms ON contains(low, word)
 UNION ALL SELECT low, concat(word, ' ', other), 2, i FROM {terms} JOIN brands ON low = word OR starts_with(low, concat(word, ' '))
 UNION ALL SELECT low, concat(low, ' ', other), 3, i FROM {terms}, modifiers WHERE i < 3 AND EXISTS (SELECT 1 FROM brands WHERE contains(low, word))
 UNION ALL SELECT low, concat(low, ' ', other), 4, i FROM {terms}, modifiers WHERE NOT contains(low, other)),
expansion AS (SELECT low, variant, row_number() OVER (PARTITION BY low ORDER BY first) AS place FROM (SELECT low, variant, min(step * 1000 + i) AS first FROM variants GROUP BY low, variant) QUALIFY place <= {most + 1})"""
