"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``window // 2`` words. A repeat of
``window`` words always covers one whole block of its earlier occurrence, so: index the blocks, probe
the index with every rolling run of that many words, and extend the hits to all windows around them.
Maximal repeats are the unions of those windows; of each window's sequence the first occurrence stays.

Work is spread twice, once by document chunk and once by hash range, and both exchanges carry packed,
sorted hashes (about four bytes a word). Each chunk sends one entry per distinct hash, so a passage
that a third of the corpus shares costs one entry per chunk, not one per occurrence or per pair.

Words are told apart by two unrelated hashes of their bytes, and windows by 64 bits made from the first and 32 from the second. Null and empty texts have no words; null ids order first, rows that share
an id come in a fixed order of chunk and text, so of repeated rows one keeps its words. Very long texts
fill a chunk of their own size. Empty tables give empty results. Other columns of docs are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_SPACE, U64, bucket_cuts, chunk_count, chunk_of, delta, encoded, fits, load, mix, pack, range_count, rolling, unpack

_ANSWER = "chunk int, bucket int, kind int, payload binary"
_FIRST = np.iinfo(np.int64).min
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0x8CB92BA72F3D8DD7


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and UTF-8 texts of a chunk, by id and then text."""
    ids = np.array([_FIRST if x is None else x for x in table["doc_id"].to_pylist()], dtype=np.int64)
    texts = encoded(table["text"])
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def _blocks(counts: np.ndarray, size: int) -> np.ndarray:
    """True at word starts where a reference block of its document begins."""
    out = np.zeros(int(counts.sum()), bool)
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
        out[end - n : end : size] = True
    return out


def _word_hashes(texts: list[bytes], both: bool = True, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word, by its bytes (the second only if both), and the number of words of each text; some texts at a time."""
    first, second, counts, lo = [np.empty(0, U64)], [np.empty(0, U64)], [np.empty(0, np.int64)], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= piece):
            size += len(texts[hi]) + 1
            hi += 1
        data = np.frombuffer(b"\n".join(texts[lo:hi]) + b"\n", np.uint8)
        inside = NOT_SPACE[data]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        counts.append(np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts[lo:hi]])), prepend=0))
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        first.append(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))[at])
        if both:
            second.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), U64, len(distinct))[at])
        lo = hi
    out = []
    for parts in (first, second, counts):
        out.append(np.concatenate(parts))
        parts.clear()
    return tuple(out)


def _slices(n: int, step: int = 1 << 17):
    """What is computed and dropped again is computed a slice at a time, so a chunk holds few arrays of its length."""
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _gram(raw: np.ndarray) -> np.ndarray:
    # 48 bits of a gram are compared: a false hit only adds candidates.
    return mix(raw) >> U64(16) << U64(16)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table({"chunk": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _send_grams(size: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        _, texts = _ordered(table)
        words, _, counts = _word_hashes(texts, both=False)
        ok = fits(counts, size)
        if not ok.any():
            return _rows([])
        grams = rolling(words, size, _BASE)
        del words
        for s in _slices(len(grams)):
            grams[s] = _gram(grams[s])
        # The low bit says that the gram is a block; sorted, a gram's blocks come after its other places.
        grams |= _blocks(counts, size)[: len(ok)]
        grams = grams[ok]
        grams.sort()
        first = _runs(grams >> U64(16))
        many = np.diff(first, append=len(grams)) > 1
        block = (grams[np.append(first[1:], len(grams)) - 1] & U64(1)).astype(bool)
        seen = grams[first] >> U64(16)
        del grams, first
        cuts, chunk, rows = bucket_cuts(seen << U64(16), buckets), table["chunk"][0].as_py(), []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                rows.append((chunk, b, 0, pack(delta(seen[i:j]) << U64(2) | many[i:j].astype(U64) << U64(1) | block[i:j])))
        return _rows(rows)

    return send


def _match_grams(table: pa.Table) -> pa.Table:
    """In one hash range: which grams of each chunk are a reference block somewhere and occur twice or more?"""
    parts = []
    for payload in table["payload"].to_pylist():
        (v,) = unpack(payload)
        parts.append(np.cumsum(v >> U64(2)) << U64(2) | v & U64(3))
    every = np.concatenate(parts)
    every.sort()
    first = _runs(every >> U64(2))
    flags = np.bitwise_or.reduceat(every & U64(3), first)
    twice = (np.diff(first, append=len(every)) > 1) | (flags & U64(2) > 0)
    good = (every[first] >> U64(2))[twice & (flags & U64(1) > 0)]
    del every, first, flags, twice
    rows = []
    for chunk, v in zip(table["chunk"].to_pylist(), parts if len(good) else []):
        v = v >> U64(2)
        mine = good[np.minimum(np.searchsorted(good, v), len(good) - 1)] == v
        if mine.any():
            rows.append((chunk, table["bucket"][0].as_py(), 0, pack(delta(v[mine]))))
    return _rows(rows)


def _found(raw: np.ndarray, ok: np.ndarray, hits: pa.Table) -> np.ndarray:
    """For each gram: is it among the hits?"""
    hit = np.concatenate([np.cumsum(unpack(p)[0]) for p in hits["payload"].to_pylist()])
    hit.sort()
    hit <<= U64(16)
    found = np.empty(len(raw), bool)
    for s in _slices(len(raw)):
        grams = _gram(raw[s])
        found[s] = hit[np.minimum(np.searchsorted(hit, grams), len(hit) - 1)] == grams
    return found & ok


def _send_windows(window: int, size: int, buckets: int):
    def send(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return _rows([])
        chunk = table["chunk"][0].as_py()
        ids, texts = _ordered(table)
        words, second, counts = _word_hashes(texts)
        del texts
        whole = fits(counts, window)
        if not len(whole):
            return _rows([])
        raw = rolling(words, size, _BASE)
        # A window is a candidate if a hit lies wholly inside it.
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_found(raw, fits(counts, size), hits), out=total[1:])
        span = window - size + 1
        start = np.flatnonzero(whole & (total[span : span + len(whole)] > total[: len(whole)])).astype(np.uint32)
        del whole, total
        if not len(start):
            return _rows([])
        h, power = np.empty(len(start), U64), U64(pow(_BASE, window - size, 1 << 64))
        if window != 2 * size:
            raw = rolling(words, window, _BASE)
        del words
        for s in _slices(len(start)):
            h[s] = mix(raw[start[s]] * power + raw[start[s] + np.uint32(size)] if window == 2 * size else raw[start[s]])
        raw = rolling(second, window, _OTHER_BASE)
        del second
        other = np.empty(len(start), np.uint32)
        for s in _slices(len(start)):
            other[s] = mix(raw[start[s]]) >> U64(32)
        del raw
        order = np.lexsort((other, h))  # stable: equal windows stay in order of their start
        h, other, start = h[order], other[order], start[order]
        del order
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (other[1:] == other[:-1])
        rows = []
        if again.any():  # repeats inside the chunk need no one else's word
            rows.append((chunk, chunk % buckets, 1, pack(delta(np.sort(start[again])))))
            h, other, start = h[~again], other[~again], start[~again]
        ends, cuts = np.cumsum(counts), bucket_cuts(h, buckets)
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                doc = ids[np.searchsorted(ends, start[i:j], side="right")]
                rows.append((chunk, b, 0, pack(delta(h[i:j]), other[i:j], doc, start[i:j])))
        return _rows(rows)

    return send


def _match_windows(table: pa.Table) -> pa.Table:
    """In one hash range: the windows of each chunk that start earlier in another one."""
    rows, parts = [], []
    for chunk, kind, payload in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist()):
        if kind == 1:
            rows.append((chunk, 0, 1, payload))
        else:
            h, other, doc, start = unpack(payload)
            parts.append((np.cumsum(h), other, doc, start, np.full(len(h), chunk, np.int32)))
    if parts:
        h, other, doc, start, owner = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((start, owner, doc, other, h))
        del doc
        h, other = h[order], other[order]
        later = order[1:][(h[1:] == h[:-1]) & (other[1:] == other[:-1])]
        del h, other, order
        start, owner = start[later], owner[later]
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        first = _runs(owner)
        for i, j in zip(first, [*first[1:], len(owner)]):
            rows.append((int(owner[i]), 0, 1, pack(delta(start[i:j]))))
    return _rows(rows)


def _keep(window: int):
    def keep(table: pa.Table, repeats: pa.Table) -> pa.Table:
        ids, texts = _ordered(table)
        start = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpack(p)[0].astype(np.int64)) for p in repeats["payload"].to_pylist())])
        start.sort()
        n_words, n_removed, begin = [], [], 0
        for k, text in enumerate(texts):  # windows lie inside one text, so each text is split and joined by itself
            words = text.split()
            n_words.append(len(words))
            mine = start[slice(*np.searchsorted(start, (begin, begin + len(words))))] - begin
            begin += len(words)
            removed = 0
            if len(mine):
                edge = np.bincount(mine, minlength=len(words) + 1) - np.bincount(mine + window, minlength=len(words) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            n_removed.append(removed)
            texts[k] = b" ".join(words)
        kept = pa.array(texts, pa.binary())
        return pa.table({"doc_id": pa.array([None if x == _FIRST else x for x in ids.tolist()], pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": kept.view(pa.string())})

    return keep


def dedup_substrings(docs: DataFrame, window: int = 20, chunk_mb: int = 32) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for each row of docs(doc_id, text).

    Words are runs of anything but ASCII white space. A word goes if a window of ``window``
    words that covers it starts earlier elsewhere (smaller doc_id, or earlier in the same document).
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    size = window // 2
    chunks = chunk_count(docs, chunk_mb)
    ranges = range_count(chunks, chunk_mb)
    texts = docs.select(F.col("doc_id").cast("long"), "text", chunk_of("doc_id", "text", chunks).alias("chunk"))
    by_chunk = texts.groupBy("chunk")
    hits = by_chunk.applyInArrow(_send_grams(size, ranges), _ANSWER).groupBy("bucket").applyInArrow(_match_grams, _ANSWER)
    repeats = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_send_windows(window, size, ranges), _ANSWER).groupBy("bucket").applyInArrow(_match_windows, _ANSWER)
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """The contract by direct search, for tests: id to words, removed words and digest of the rest."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


OP2_SQL = r"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM d, unnest(range(1, greatest(1, len(w) - 18))) t(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS p, count(DISTINCT p) AS n FROM later, unnest(range(i, i + 20)) t(p) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN (SELECT doc_id, unnest(p) AS k FROM gone) USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
