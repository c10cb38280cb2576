"""Benchmark decontamination by a prefix-filtered set join with exact, item-sized windows.

The shingles of an item are its windows of 13 consecutive words (one window of all words for shorter
items). Containment must be whole, so the necessary prefix of a window, its words ordered by rarity, is
its single rarest word: a document can only contain the window if it holds that word. Rarity is the number
of documents that hold a word, counted over all of them; a window with a word that no document holds is out.

Documents' distinct words are joined with the windows' prefixes, and each document meets its windows once. Where
its prefix stands in the document proposes a start; the length and positional bounds (the window must fit
around that position) come first, then the words are compared one by one.

Neither side travels through the driver: words are joined by 64 bits of hash. Before each exchange a filter of
2^22 bits, which is the same size for every benchmark, leaves out words that no window asks for.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import encoded, load, materialize, remove, word_hashes

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IS_WORD[128:] = True
_FILTER_BITS = 22
_KEY = ["_row_hash", "_row_hash_2"]


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after A-Z were lower-cased, as UTF-8."""
    return _WORD.findall(text.lower())


def windows_of(words: list, window: int) -> list[list]:
    """The windows of an item: of so many words, or one of all its words if it has fewer."""
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []


def _windows(window: int):
    def windows(batches):
        for batch in batches:
            items, grams, hashes = [], [], []
            for item, text in zip(batch["item_id"].to_pylist(), encoded(batch["text"])):
                own = word_hashes([text], _IS_WORD, _FOLD)[0].view(np.int64).tolist()
                for gram, numbers in zip(windows_of(words_of(text), window), windows_of(own, window)):
                    items.append(item)
                    grams.append(b" ".join(gram))
                    hashes.append(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(grams, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "gram", "words"])

    return windows


def _filter(words: DataFrame) -> bytes:
    """Which remainders of hashes occur in words(word): 2^22 bits, whatever the number of words."""
    kept = np.zeros(1 << _FILTER_BITS, bool)
    kept[words.select((F.col("word").bitwiseAND((1 << _FILTER_BITS) - 1)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(kept).tobytes()


def _asked(texts: list[bytes], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word hashes of each text that pass the filter, as pairs (text, word) in order."""
    hashes, counts = word_hashes(texts, _IS_WORD, _FOLD)
    at = np.flatnonzero(bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)])
    text, words = np.repeat(np.arange(len(texts)), counts)[at], hashes[at].view(np.int64)
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (words[1:] != words[:-1])
    return text[new], words[new]


def _count(filter_: bytes):
    """How many texts of a batch hold each word that passes the filter."""

    def count(batches):
        bits = np.unpackbits(np.frombuffer(filter_, np.uint8)).view(bool)
        for batch in batches:
            words, n = np.unique(_asked(encoded(batch["text"]), bits)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": words, "n": n.astype(np.int64)})

    return count


def _propose(filter_: bytes):
    """Each text's key with its distinct words that pass the filter."""

    def propose(batches):
        bits = np.unpackbits(np.frombuffer(filter_, np.uint8)).view(bool)
        for batch in batches:
            text, words = _asked(encoded(batch["text"]), bits)
            keys = [batch[k].take(pa.array(text)) for k in _KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(words)], [*_KEY, "word"])

    return propose


def _find(batches):
    """Spans, items and number of words of each document, from its text and the windows it may contain."""
    for batch in batches:
        spans, found, sizes = [], [], []
        for text, proposed in zip(encoded(batch["text"]), batch["_proposed"].to_pylist()):
            words = words_of(text)
            n, hits, ids = len(words), set(), set()
            if proposed:
                at: dict[bytes, list[int]] = {}
                wanted = [(w["offset"], w["gram"].split(b" "), w["items"]) for w in proposed]
                prefixes = {gram[offset] for offset, gram, _ in wanted}
                for i, word in enumerate(words):
                    if word in prefixes:
                        at.setdefault(word, []).append(i)
                for offset, gram, items in wanted:
                    size = len(gram)
                    for i in at.get(gram[offset], ()):
                        start = i - offset
                        if start >= 0 and start + size <= n and words[start : start + size] == gram:
                            hits.add((start, start + size))
                            ids.update(items)
            spans.append([{"start": a, "end": b} for a, b in sorted(hits)])
            found.append(sorted(ids))
            sizes.append(n)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        new = {"n_words": pa.array(sizes, pa.int64()), "items": pa.array(found, pa.list_(pa.int64())), "spans": pa.array(spans, kind)}
        old = [name for name in batch.schema.names if name not in (*_KEY, "_proposed")]
        yield pa.RecordBatch.from_arrays([*(batch[name] for name in old), *new.values()], [*old, *new])


def prefix_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """word (hash of the rarest one), offset, gram and items of each window whose words all occur in docs(text)."""
    texts = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    grams = texts.mapInArrow(_windows(window), "item_id long, gram binary, words array<long>")
    grams = materialize(grams.groupBy("gram", "words").agg(F.collect_set("item_id").alias("items")), "windows")
    asked = grams.select("gram", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    held = docs.select("text").mapInArrow(_count(_filter(asked)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rarest = asked.join(held, "word").groupBy("gram", "size").agg(F.count("*").alias("found"), F.min(F.struct("n", "word", "offset")).alias("rare"))
    rarest = rarest.where("found = size").select("gram", "rare.word", "rare.offset")
    prefixes = materialize(rarest.join(grams.select("gram", "items"), "gram").select("word", "offset", "gram", "items"), "prefixes")
    remove(docs.sparkSession, grams)
    return prefixes


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_hit, items, spans and contaminated.

    A word is hit if it lies in an occurrence of a benchmark window; a document is contaminated if at
    least one word ``one_in`` so many of its words is hit. spans are the occurrences, as word numbers.
    Columns of docs that bear one of these five names are replaced.

    Null and empty texts have no words; very long ones are read whole. Items without an id mark words but are not
    listed; repeated items count once per id. Rows are told apart by 128 bits of hash of id and text; repeated rows
    get equal results. Empty documents give an empty result, an empty benchmark hits nothing.
    """
    out = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    names = out.columns
    prefixes = prefix_windows(docs, benchmark, window)
    text = F.coalesce("text", F.lit(""))
    keyed = out.withColumns({_KEY[0]: F.xxhash64("doc_id", text), _KEY[1]: F.xxhash64(F.lit(1), text, "doc_id")})
    proposed = keyed.select(*_KEY, "text").mapInArrow(_propose(_filter(prefixes)), f"{_KEY[0]} long, {_KEY[1]} long, word long").distinct()
    proposed = proposed.join(prefixes, "word").groupBy(*_KEY).agg(F.collect_list(F.struct("offset", "gram", "items")).alias("_proposed"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    both = keyed.join(proposed, _KEY, "left").select(*names, "_proposed")
    out = both.mapInArrow(_find, f"{kind}, n_words long, items array<bigint>, spans array<struct<start:int,end:int>>")
    covered = F.aggregate(  # words under the union of spans, which are sorted by start
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    n_hit = F.col("n_hit")
    return out.select(*names, "n_words", "items", "spans", covered.alias("n_hit")).withColumn("contaminated", (n_hit > 0) & (one_in * n_hit >= F.col("n_words")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP7_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, greatest(1, len(w) - k + 2))) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
