"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Shingle counts. Chunks of documents send each distinct shingle once, with its number of documents,
   packed and sorted, to its hash range; the answer names the shingles that two documents or more hold.
2. Signatures. A shingle weighs tf * idf, with idf = 1 + span * (1 - log(df) / log(documents)), so within 1 and
   1.25 at every corpus size: rare shingles count more, and similarity stays close to that of plain counts, in which
   the threshold is meant (a wider span takes copies of large groups below it, as their common shingles count least). A document can only have a partner at similarity s if a share s of its weight
   lies on shingles that others hold too; all others end here. The rest get ``bands * rows`` samples:
   each sample draws r and c from Gamma(2, 1) and b from U(0, 1) per shingle and slot, sets
   t = floor(ln w / r + b), ln a = ln c - r (t - b) - r, and keeps the (shingle, t) of the least a.
   Every sample is drawn from all shingles, whatever the text's size.
3. Candidates share a band. In each band bucket every text is verified against the one with the least
   weight of its own (the likeliest original); texts linked to the same original are one cluster.
4. Clusters that meet in a bucket without a link form open groups, which are compared exactly: every text
   outside a group's largest cluster against all texts of the group that share a band with it, in blocks.
   So each pair that shares a band and is not yet connected is verified. Classes are components of all links.

Texts with equal words (ASCII letters in either case) are one node. Documents with fewer than five words
have one shingle of all words. Documents without words (null, empty), or without an id, are classes of their own.
Very long texts are sampled in pieces of draws, from all their shingles. Repeated rows, and rows that share an id
but not the text, count as documents of their own; ties of the least weight go to the least digest. An empty
table gives an empty result. Other columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import U64, bucket_cuts, chunk_count, chunk_of, delta, encoded, fits, load, materialize, mix, pack, range_count, remove, rolling, unpack, word_hashes
from tidemark.llm.components import components

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ANSWER = "chunk int, bucket int, payload binary"
_SIGNED = "doc_id long, mark long, node string, total double, own double, vec binary, bands array<long>"
_LINKS = "u string, v string"
#: So many draws are held at a time.
_DRAWS = 1 << 18


def _shingles(texts: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes (48 bits, sorted) and how often each occurs."""
    words, counts = word_hashes(texts, fold=_FOLD)
    every, ok = mix(rolling(words, k, 0x9E3779B97F4A7C15)) >> U64(16), fits(counts, k)
    out, begin = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(every[begin : begin + n - k + 1], return_counts=True))
        elif n:
            out.append((mix(rolling(words[begin : begin + n], n, 0x9E3779B97F4A7C15) + U64(n)) >> U64(16), np.ones(1, np.int64)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
        begin += n
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"chunk": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()), "payload": pa.array(cols[2], pa.binary())})


def _send_counts(k: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        parts = [h for h, _ in _shingles(encoded(table["text"]), k) if len(h)]
        if not parts:
            return _rows([])
        seen, times = np.unique(np.concatenate(parts), return_counts=True)
        cuts, chunk = bucket_cuts(seen << U64(16), buckets), table["chunk"][0].as_py()
        return _rows([(chunk, b, pack(delta(seen[i:j]), times[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i])

    return send


def _shared(table: pa.Table) -> pa.Table:
    """In one hash range: for each chunk its shingles that two documents or more hold, with 8 log2 of how many."""
    values, times = zip(*[(np.cumsum(v), n) for v, n in (unpack(p) for p in table["payload"].to_pylist())])
    _, at = np.unique(np.concatenate(values), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate(times))
    code = np.minimum(255, np.rint(8 * np.log2(df))).astype(np.uint8)[at]
    rows, start = [], 0
    for chunk, v in zip(table["chunk"].to_pylist(), values):
        mine = code[start : start + len(v)]
        start += len(v)
        if (some := mine > 0).any():
            rows.append((chunk, table["bucket"][0].as_py(), pack(delta(v[some]), mine[some])))
    return _rows(rows)


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 fixed draws each of r, ln c and b."""
    rng = np.random.default_rng(7)
    return rng.gamma(2, 1, 1 << 16), np.log(rng.gamma(2, 1, 1 << 16)), rng.random(1 << 16)


def _sample(hashes: np.ndarray, log_w: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of every shingle (columns) under every seed (rows)."""
    r_all, c_all, b_all = _draws()
    x = (hashes[None, :] + seeds[:, None]) * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    r, c, b = r_all[x >> U64(48)], c_all[(x >> U64(32)) & U64(0xFFFF)], b_all[(x >> U64(16)) & U64(0xFFFF)]
    t = np.floor(log_w / r + b)
    return c - r * (t - b) - r, t


def _signature(hashes: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """One consistent weighted sample per slot, each from all shingles."""
    log_w = np.log(weights)
    seeds = mix(np.arange(1, slots + 1, dtype=np.uint64))
    least, out = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    step = max(1, _DRAWS // max(1, len(hashes)))
    for i in range(0, len(hashes), _DRAWS):
        own = hashes[i : i + _DRAWS]
        for k in range(0, slots, step):
            a, t = _sample(own, log_w[i : i + _DRAWS], seeds[k : k + step])
            best, row = a.argmin(axis=1), np.arange(len(a))
            value = own[best] * U64(0x9E3779B97F4A7C15) + t[row, best].astype(np.int64).view(np.uint64)
            less = a[row, best] < least[k : k + step]
            least[k : k + step][less], out[k : k + step][less] = a[row, best][less], value[less]
    return out


def _bands(hashes: np.ndarray, weights: np.ndarray, bands: int, rows: int) -> list[int]:
    key = mix(np.arange(bands, dtype=np.uint64) * U64(2))
    for column in mix(_signature(hashes, weights, bands * rows)).reshape(bands, rows).T:
        key = mix(key * U64(0xC2B2AE3D27D4EB4F) + column)
    return key.view(np.int64).tolist()


def _signed_rows(rows: list[tuple]) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "node": pa.string(), "total": pa.float64(), "own": pa.float64(), "vec": pa.binary(), "bands": pa.list_(pa.int64())}
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), cols)})


def _sign(k: int, bands: int, rows: int, similarity: float, n_docs: int, span: float):
    scale = 1 / max(1e-9, math.log2(max(2, n_docs)))

    def sign(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _signed_rows([])
        known, code = np.empty(0, np.uint64), np.empty(0, np.uint8)
        if shared.num_rows:
            known, code = (np.concatenate(x) for x in zip(*[(np.cumsum(v), c) for v, c in (unpack(p) for p in shared["payload"].to_pylist())]))
            order = np.argsort(known)
            known, code = known[order], code[order]
        texts = encoded(table["text"])
        out, done = [], {}
        for doc, mark, text, (hashes, times) in zip(table["doc_id"].to_pylist(), table["mark"].to_pylist(), texts, _shingles(texts, k)):
            if doc is None or not len(hashes):
                out.append((doc, mark, None, 0.0, 0.0, None, None))
                continue
            node = hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).hexdigest()
            if node not in done:
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                both = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                idf = np.full(len(hashes), 1.0 + span)
                if len(known):
                    idf[both] -= span * np.minimum(1.0, code[at[both]] / 8.0 * scale)
                weights = times * idf
                total, held = float(weights.sum()), float(weights[both].sum())
                if held >= similarity * total:
                    vec = pack(delta(hashes[both]), weights[both].astype(np.float32))
                    done[node] = (total, (total - held) / total, vec, _bands(hashes, weights, bands, rows))
                else:
                    done[node] = (total, (total - held) / total, None, None)
            out.append((doc, mark, node, *done[node]))
        return _signed_rows(out)

    return sign


def _likeness(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (total, hashes, weights)."""
    _, i, j = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[2][i], b[2][j]).astype(np.float64).sum())
    return common / (a[0] + b[0] - common)


def _vector(total: float, vec: bytes) -> tuple:
    hashes, weights = unpack(vec)
    return total, np.cumsum(hashes), weights


def _verify(similarity: float):
    def verify(batches):
        kept_key, kept = None, None
        for batch in batches:
            u, v, own = [], [], []
            c = batch.to_pydict()
            for node, total, vec, center, c_own, c_total, c_vec in zip(*(c[x] for x in ("node", "total", "vec", "center", "c_own", "c_total", "c_vec"))):
                if center != kept_key:
                    kept_key, kept = center, _vector(c_total, c_vec)
                if min(total, c_total) >= similarity * max(total, c_total) and _likeness(_vector(total, vec), kept) >= similarity:
                    u.append(node)
                    v.append(center)
                    own.append(c_own)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.string()), "v": pa.array(v, pa.string()), "own": pa.array(own, pa.float64())})

    return verify


def _compare(similarity: float):
    """Verify the asking texts of a block against the other block's, where they share a band and are not yet connected."""

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asking, others = [x for x in rows if x["asks"]], [x for x in rows if not x["asks"]]
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        by_band: dict[int, list[int]] = {}
        for i, x in enumerate(others):
            for key in x["bands"]:
                by_band.setdefault(key, []).append(i)
        vectors: dict[int, tuple] = {}
        links: list[tuple[str, str]] = []
        for x in asking:
            meets: dict[int, int] = {}
            for key in x["bands"]:
                for i in by_band.get(key, ()):
                    meets[i] = meets.get(i, 0) + 1
            mine = None
            for i in sorted(meets, key=lambda i: (-meets[i], others[i]["node"])):
                y = others[i]
                if root(x["comp"]) == root(y["comp"]) or min(x["total"], y["total"]) < similarity * max(x["total"], y["total"]):
                    continue
                mine = mine or _vector(x["total"], x["vec"])
                if i not in vectors:
                    vectors[i] = _vector(y["total"], y["vec"])
                if _likeness(mine, vectors[i]) >= similarity:
                    links.append((x["node"], y["node"]))
                    parent[root(x["comp"])] = root(y["comp"])
        return pa.table({"u": pa.array([a for a, _ in links], pa.string()), "v": pa.array([b for _, b in links], pa.string())})

    return compare


def mark_of(text: str) -> Column:
    """A hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5, chunk_mb: int = 32, block_mb: int = 4, block_rows: int = 512, span: float = 0.25) -> DataFrame:
    """doc_id, mark, class_id (the least doc_id of its class), n_links and is_first, for each row of docs(doc_id, text).

    Classes are the connected components of "equal words, or weighted Jaccard similarity of at least
    ``similarity`` over shingles of ``words`` words". A pair at 0.8 shares none of the 24 bands with
    probability 7e-5, one at 0.85 with 8e-7. mark is a hash of the text, which tells rows of one id apart; is_first
    is true for the rows of the least (doc_id, mark) of a class. n_links counts the verified links of the
    row's text to other texts; links inside what is connected already need no verification and are not counted.
    """
    chunks = chunk_count(docs, chunk_mb)
    by_chunk = docs.select(F.col("doc_id").cast("long"), mark_of("text").alias("mark"), "text", chunk_of("doc_id", "text", chunks).alias("chunk")).groupBy("chunk")
    shared = by_chunk.applyInArrow(_send_counts(words, range_count(chunks, chunk_mb)), _ANSWER).groupBy("bucket").applyInArrow(_shared, _ANSWER)
    signed = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_sign(words, bands, rows, similarity, docs.count(), span), _SIGNED)
    signed = materialize(signed, "signed")

    nodes = materialize(signed.where("bands is not null").select("node", "total", "own", "vec", "bands").dropDuplicates(["node"]), "nodes")
    members = nodes.select("node", "own", F.explode("bands").alias("band"))
    centers = members.groupBy("band").agg(F.min(F.struct("own", "node")).alias("c"), F.count("*").alias("n")).where("n > 1").select("band", F.col("c.node").alias("center"))
    pairs = materialize(members.join(centers, "band").where("node <> center").select("node", "center").distinct(), "pairs")
    sides = nodes.select("node", "total", "vec")
    both = pairs.join(sides, "node").join(nodes.select(F.col("node").alias("center"), F.col("own").alias("c_own"), F.col("total").alias("c_total"), F.col("vec").alias("c_vec")), "center")
    links = materialize(both.mapInArrow(_verify(similarity), "u string, v string, own double"), "links")

    # Of the centers a text is linked to, the likeliest original, and its own in turn: texts with one label are connected.
    best = links.groupBy("u").agg(F.min(F.struct("own", "v")).alias("b")).select(F.col("u").alias("node"), F.col("b.v").alias("comp"))
    further = best.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    comps = materialize(best.join(further, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "comps")
    open_ = pairs.join(comps, "node", "left").select(F.coalesce("comp", "node").alias("u"), "center")
    open_ = open_.join(comps.withColumnRenamed("node", "center"), "center", "left").select("u", F.coalesce("comp", "center").alias("v"))
    groups = components(open_).select(F.col("node").alias("comp"), F.col("root").alias("grp"))
    placed = nodes.select("node", F.length("vec").alias("size")).join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "size")
    placed = materialize(placed.join(groups, "comp"), "placed")
    per_comp = placed.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per_group = per_comp.groupBy("grp").agg(F.max(F.struct("n", "size", "comp")).alias("top"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    # A block is bounded in bytes and in rows; comparisons of a large group are so spread over tasks.
    blocks = lambda size, n: F.greatest(F.ceil((size + 1) / (block_mb << 20)), F.ceil((n + 1) / block_rows)).cast("int")
    asking = blocks(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n"))
    per_group = per_group.select("grp", F.col("top.comp").alias("top"), blocks(F.col("size"), F.col("n")).alias("blocks"), asking.alias("ask_blocks"))
    spread = placed.join(per_group, "grp").join(nodes.select("node", "total", "vec", "bands"), "node")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "node", "comp", "total", "vec", "bands"]
    asks = spread.where("comp <> top").select(*columns, F.lit(True).alias("asks"), at("ask_blocks").alias("p"), all_of("blocks").alias("q"))
    answers = spread.select(*columns, F.lit(False).alias("asks"), all_of("ask_blocks").alias("p"), at("blocks").alias("q"))
    late = materialize(asks.unionByName(answers).groupBy("grp", "p", "q").applyInArrow(_compare(similarity), _LINKS), "late")
    every = links.select("u", "v").unionByName(late)
    found = components(every)
    ends = every.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    joined = materialize(found.join(ends, "node"), "classes")
    for done in (nodes, pairs, links, comps, groups, placed, late, found):
        remove(docs.sparkSession, done)

    firsts = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n")).join(joined, "node", "left")
    firsts = firsts.where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("of_class")), "root").select("node", "of_class", "n_links")
    out = signed.select("doc_id", "mark", "node").join(classes, "node", "left")
    is_first = (F.col("doc_id") == F.col("of_class.doc_id")) & (F.col("mark") == F.col("of_class.mark"))
    return out.select("doc_id", "mark", F.coalesce("of_class.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(is_first, F.lit(True)).alias("is_first"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "is_first")
