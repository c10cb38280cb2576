"""Shared helpers: partition sizing, tables in the shared folder, vectorised word hashing, packed columns."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Words end at these bytes: space and the ASCII controls 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master where none is set."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def chunk_count(df: DataFrame, chunk_mb: int = 32) -> int:
    """How many chunks hold the rows of df at about chunk_mb of text each; grows with the input."""
    spark = df.sparkSession
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown
        return 2 * least
    return max(least, -(-size * 4 // (chunk_mb << 20)))


def range_count(chunks: int, chunk_mb: int = 32) -> int:
    """How many hash ranges a chunk sends its hashes to.

    As many as chunks, so a range is no larger than a chunk, but never so many that a full chunk sends fewer than
    about 80 hashes to one: beyond that the messages grow in proportion to the input, not to its square. Inputs of
    so many chunks want a larger chunk_mb, which holds the ranges' size in step.
    """
    return max(1, min(chunks, chunk_mb << 11))


def chunk_of(key: str, text: str, chunks: int) -> Column:
    """Rows are spread by key and text, so neither a frequent key nor rows without one share a chunk."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(chunks)).cast("int")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xFF51AFD7ED558CCD)
    return h ^ (h >> U64(32))


#: Bytes up to which a polynomial modulo 2^64 tells words apart; words made to collide under every base (Thue-Morse) have 1024 and more.
LONG_WORD = 255


def word_pieces(texts: list[bytes], is_word: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None, piece: int = 4 << 20):
    """The words of all texts, some texts at a time: (first text, folded bytes with a line feed after each text, start, length and hash of each word, words per text).

    Words are maximal runs of bytes b with is_word[b], not the line feed; fold maps bytes first (to lower case, say).
    """
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= piece):
            size += len(texts[hi]) + 1
            hi += 1
        part = texts[lo:hi]
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        if fold is not None:
            data = fold[data]
        inside = is_word[data]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        doc_starts = np.cumsum([0] + [len(x) + 1 for x in part[:-1]])
        counts = np.bincount(np.searchsorted(doc_starts, starts, side="right") - 1, minlength=len(part))
        hashes, lens = np.empty(0, np.uint64), ends - starts
        if len(starts):
            offs = np.cumsum(lens) - lens
            pos = np.arange(lens.sum()) - np.repeat(offs, lens)
            power = np.cumprod(np.full(int(lens.max()), _BASE, dtype=np.uint64))
            raw = np.add.reduceat(_BYTE[data[inside]] * power[pos], offs)
            hashes = mix(raw + lens.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
            for i in np.flatnonzero(lens > LONG_WORD):
                hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
        yield lo, data, starts, lens, hashes, counts
        lo = hi


def word_hashes(texts: list[bytes], is_word: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    pieces = [(h, n) for *_, h, n in word_pieces(texts, is_word, fold)]
    if not pieces:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in pieces]), np.concatenate([n for _, n in pieces])


def rolling(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Unmixed polynomial hashes of every k consecutive words (document bounds are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= U64(base)
        out += words[j : n + j]
    return out


def fits(counts: np.ndarray, k: int) -> np.ndarray:
    """For each word start up to the last full window: does its window of k words end inside its document?"""
    total = int(counts.sum())
    if total < k:
        return np.empty(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + k <= ends)[: total - k + 1]


_CODES = {"u1": 1, "u4": 4, "u8": 8, "i8": 8, "f4": 4}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together, so small numbers shrink."""
    parts = []
    for a in arrays:
        code = a.dtype.str[1:]
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, _CODES[code]).T
        parts.append(struct.pack("<2sI", code.encode(), len(a)) + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        code, n = struct.unpack_from("<2sI", raw, at)
        width = _CODES[code.decode()]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 6).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<{code.decode()}").reshape(n))
        at += 6 + n * width
    return out


def delta(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of equal hash range starts in sorted 64-bit hashes."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]))


def encoded(column) -> list[bytes]:
    """A text column of an Arrow table as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


