"""Document fingerprints by content-defined chunking with normalised gear-hash boundaries.

The gear hash of the last 32 bytes is computed for all positions at once. A chunk ends at the first
position past ``least`` bytes where the hash passes a strict mask, past ``normal`` bytes a lenient one, and
at ``most`` bytes in any case, so an edit moves boundaries only near itself. A fingerprint is the set of chunk
digests, each with the bytes it stands for: hex of 8 bytes of digest and 4 of length per chunk, by digest.

Likeness is containment: the share of one fingerprint's bytes that the other holds too. Two empty texts
are alike (1), an empty and another one are not (0). Null texts are empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunk_count, load

_PAD = 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_PAIR = np.dtype([("digest", ">u8"), ("size", ">u4")])


def chunks_of(texts: list[bytes], least: int = 16, normal: int = 48, most: int = 256) -> list[list[bytes]]:
    """Content-defined chunks of each text; together they are the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = (b"\0" * _PAD).join([b"", *texts])
    begin = np.cumsum(sizes + _PAD) - sizes
    end = begin + sizes
    value = _GEAR[np.frombuffer(data, np.uint8)]
    pads = np.ones(len(data), bool)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    pads = np.cumsum(edge[:-1]) == 0
    value[pads] = 0
    for shift in (1, 2, 4, 8, 16):
        new = value.copy()
        new[shift:] += value[:-shift] << np.uint32(shift)
        value = new
    n = len(value)
    following = []
    bits = int(np.log2(normal))
    for width in (bits + 2, bits - 2):
        at = np.where(value >> np.uint32(32 - width) == 0, np.arange(n), n)
        following.append(np.minimum.accumulate(at[::-1])[::-1])
    strict, lenient = following
    start, who = begin.copy(), np.arange(len(texts))
    cuts = [[] for _ in texts]
    alive = start < end
    start, who, stop = start[alive], who[alive], end[alive]
    starts, stops, owners = [], [], []
    while len(start):
        last = n - 1
        early = strict[np.minimum(start + least - 1, last)] + 1
        late = lenient[np.minimum(start + normal - 1, last)] + 1
        to = np.where(early < start + normal, early, np.minimum(late, start + most))
        to = np.minimum(to, stop)
        starts.append(start)
        stops.append(to)
        owners.append(who)
        alive = to < stop
        start, who, stop = to[alive], who[alive], stop[alive]
    for a, b, w in zip(starts, stops, owners):
        for i, j, k in zip(a.tolist(), b.tolist(), w.tolist()):
            cuts[k].append(data[i:j])
    return cuts


def fingerprint(chunks: list[bytes]) -> np.ndarray:
    """Distinct chunk digests in order, each with the bytes of all its chunks."""
    digests = np.array([xxhash.xxh3_64_intdigest(c) for c in chunks], np.uint64)
    seen, at = np.unique(digests, return_inverse=True)
    out = np.empty(len(seen), _PAIR)
    out["digest"] = seen
    out["size"] = np.bincount(at, weights=[len(c) for c in chunks], minlength=len(seen)) if len(seen) else 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes that b holds."""
    if not len(a):
        return float(not len(b))
    _, i, j = np.intersect1d(a["digest"], b["digest"], assume_unique=True, return_indices=True)
    return float(np.minimum(a["size"][i], b["size"][j]).sum(dtype=np.int64) / a["size"].sum(dtype=np.int64))


def _neighbours(batches):
    """Rows in order of bucket and id: each row that is no visitor, with the text of the row after it."""
    held = None
    for batch in batches:
        rows = batch.to_pylist()
        if held is not None:
            rows.insert(0, held)
        if rows:
            held = rows.pop()
            following = [*rows[1:], held]
            part, size = [], 0
            for row, after in zip(rows, following):
                if not row["visitor"]:
                    part.append((row["doc_id"], row["text"] or "", after["text"] or ""))
                    size += 2 * len(part[-1][1])
                    if size > 2 << 20:
                        yield part
                        part, size = [], 0
            if part:
                yield part


def _fingerprint_rows(batches):
    for part in _neighbours(batches):
        edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, after in part]
        every = [x.encode("utf-8", "surrogatepass") for x in [*[t for _, t, _ in part], *edited]]
        prints = [fingerprint(c) for c in chunks_of(every)]
        own, other = prints[: len(part)], prints[len(part) :]
        known = {text: p for (_, text, _), p in zip(part, own)}
        missing = [after for _, _, after in part if after not in known]
        known.update(zip(missing, (fingerprint(c) for c in chunks_of([x.encode("utf-8", "surrogatepass") for x in missing]))))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([x[0] for x in part], pa.int64()),
                "n_chars": pa.array([len(x[1]) for x in part], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in every[len(part) :]], pa.string()),
                "fingerprint": pa.array([x.tobytes().hex() for x in own], pa.string()),
                "edited_fingerprint": pa.array([x.tobytes().hex() for x in other], pa.string()),
                "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                "near_next": pa.array([likeness(a, known[x[2]]) for a, x in zip(own, part)], pa.float64()),
            }
        )


def fingerprints(docs: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, with likenesses to the edited and the next text.

    The next row in order of doc_id (null first, rows that share an id by text; after the last the first)
    comes from a range split: quantiles of the ids, which are ids themselves, start the buckets, and the row that
    starts a bucket also visits the end of the one before. One shuffle; tasks stream over their sorted rows.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(least))
    keyed = docs.select(key.alias("key"), F.col("doc_id").cast("long"), "text")
    buckets = max(2 * chunk_count(docs), -(-docs.count() // rows_per_bucket))
    steps = [i / buckets for i in range(buckets)]
    row = keyed.agg(F.percentile_approx("key", steps, max(10000, 20 * buckets)).alias("q"), F.min("key").alias("least")).first()
    bounds = np.array(sorted({row["least"], *(row["q"] or [])} - {None}), np.int64)
    last = max(0, len(bounds) - 1)

    @F.pandas_udf("array<int>")
    def bucket(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.int64)
        at = np.searchsorted(bounds, values, side="right") - 1
        begins = bounds[at] == values
        return pd.Series([[b, b - 1 if b else last] if s else [b] for b, s in zip(at.tolist(), begins.tolist())])

    spread = keyed.select("key", "doc_id", "text", F.posexplode(bucket("key")).alias("visitor", "bucket"))
    ordered = spread.repartition("bucket").sortWithinPartitions("bucket", "visitor", "key", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "visitor").mapInArrow(_fingerprint_rows, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))
