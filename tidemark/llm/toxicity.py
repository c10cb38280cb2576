"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence scores sigma(bias + sum of the weights of its words and of their beginnings); a document scores
1 - prod(1 - sentence). Features are words (runs of letters, digits and non-ASCII bytes, ASCII letters in
lower case) and their first 4 to 7 bytes, hashed to 2^20 slots. A feature is used if the labels of the training
documents that hold it deviate beyond chance, by a likelihood ratio above 2 ln(features); the weights of those
are fitted by full-batch Adam on the likelihood of the document labels alone. The fit sees at most ``max_train``
labelled documents (those with the least hash of their id), so it has a fixed size; features are counted and
chosen by Spark aggregates. Every document is then scored whole, in one pass without a shuffle, and its
offending sentences are located.

Texts without words score by no sentence at all: 0. Null texts are empty; documents without an id are scored
like others, very long ones in pieces of whole texts. Repeated rows get equal scores; of rows that share an id
one is learned from, and of conflicting labels of an id the toxic one. Unlabelled rows, null labels and held-out
rows are never learned from. With no labels, or one label only, all scores are 0 (to 1e-8). Columns named
score or sentences are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import U64, encoded, load, materialize, mix, word_pieces

_SLOTS = 20
_BEGINNINGS = (4, 5, 6, 7)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\r")] = True


def held_out(doc_id):
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _slots(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The slots of each word: its own, and those of its beginnings (0, which is never learned, where it is no longer than that)."""
    out, value = [hashes], np.zeros(len(starts), np.uint64)
    last = len(data) - 1
    for i in range(max(_BEGINNINGS)):
        value = value * U64(0x100000001B3) + data[np.minimum(starts + i, last)]
        if i + 1 in _BEGINNINGS:
            out.append(np.where(lens > i + 1, mix(value + U64((i + 1) << 60)), U64(0)))
    return (np.stack(out, axis=1) >> U64(64 - _SLOTS)).astype(np.int32)


def _sentences(texts: list[bytes]):
    """Some texts at a time: (first text, slots of each word, first word of each sentence, sentences per text, start and end of each sentence in bytes of its text)."""
    for lo, data, starts, lens, hashes, counts in word_pieces(texts, _WORD, _FOLD):
        ends = np.flatnonzero(_STOP[data])  # each text has a line feed at its end
        number = np.searchsorted(ends, starts)
        first = np.flatnonzero(np.diff(number, prepend=-1) != 0)
        owner = np.repeat(np.arange(len(counts)), counts)[first]
        begin = np.cumsum([0] + [len(x) + 1 for x in texts[lo : lo + len(counts) - 1]])
        per_doc = np.bincount(owner, minlength=len(counts))
        yield lo, _slots(data, starts, lens, hashes), first, per_doc, starts[first] - begin[owner], ends[number[first]] - begin[owner]


def _of_documents(batches):
    """Label, slots of each word and words of each sentence, one document at a time."""
    for batch in batches:
        texts = encoded(batch["text"])
        labels = batch["toxic"].to_pylist()
        for lo, slots, first, per_doc, _, _ in _sentences(texts):
            bounds, s = np.append(first, len(slots)), 0
            for i, n in enumerate(per_doc.tolist()):
                own = bounds[s : s + n + 1]
                yield labels[lo + i], slots[own[0] : own[-1]], np.diff(own)
                s += n


def _held(batches):
    """How many documents, and how many toxic ones, hold each slot; slot -1 counts them all."""
    held, toxic = np.zeros((2, (1 << _SLOTS) + 1), np.int64)
    for label, slots, sizes in _of_documents(batches):
        if len(sizes):
            mine = np.append(np.unique(slots), -1)
            held[mine] += 1
            toxic[mine] += label
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"slot": np.where(at == 1 << _SLOTS, -1, at).astype(np.int32), "held": held[at], "toxic": toxic[at]})


def _patterns(telling: np.ndarray):
    """Per document its distinct sentences, as lists of telling slots, each with how often it occurs."""

    def patterns(batches):
        number = np.full(1 << _SLOTS, -1, np.int32)
        number[telling] = np.arange(len(telling))
        rows = []
        for label, slots, sizes in _of_documents(batches):
            found = number[slots]
            word, column = np.nonzero(found >= 0)
            sentence = np.repeat(np.arange(len(sizes)), sizes)[word]
            seen: Counter = Counter()
            cuts = np.flatnonzero(np.diff(sentence, prepend=-1, append=-1)) if len(sentence) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                seen[tuple(sorted(found[word[i:j], column[i:j]].tolist()))] += 1
            if blank := len(sizes) - seen.total():
                seen[()] = blank
            if seen:
                ordered = sorted(seen.items())
                rows.append((label, [n for _, n in ordered], [len(x) for x, _ in ordered], [k for x, _ in ordered for k in x]))
        cols = list(zip(*rows)) or [[], [], [], []]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, ints) for c in cols[1:])], ["toxic", "times", "sizes", "slots"])

    return patterns


def telling_slots(sample: DataFrame) -> np.ndarray:
    """Slots whose documents in sample(text, toxic) are toxic more often than chance explains; at most 2^20 numbers."""
    counts = sample.mapInArrow(_held, "slot int, held long, toxic long").groupBy("slot").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "toxicity-slots")
    n, toxic, features = counts.agg(F.max(F.when(F.col("slot") < 0, F.col("held"))), F.max(F.when(F.col("slot") < 0, F.col("toxic"))), F.count_if(F.expr("held > 1 and slot >= 0"))).first()
    if not n or toxic in (0, n):
        return np.empty(0, np.int32)
    rate, own = F.lit(toxic / n), F.col("toxic") / F.col("held")
    ratio = 2 * (F.col("toxic") * F.ln(own / rate) + F.coalesce((F.col("held") - F.col("toxic")) * F.ln((1 - own) / (1 - rate)), F.lit(0.0)))
    good = counts.where("slot > 0").where((own > rate) & (ratio > 2 * math.log(max(2, features))))
    return good.select("slot").orderBy("slot").toArrow()["slot"].to_numpy().astype(np.int32)


def fit(rows: list[tuple[int, list[int], list[int], list[int]]], slots: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Slot weights and bias that make the noisy-or of each document's sentences fit its label.

    A row is a document: its label, then for its distinct sentences how often each occurs, how many telling
    slots it has, and their numbers within slots, one after the other.
    """
    weights, bias = np.zeros(1 << _SLOTS, np.float32), -20.0
    if len({r[0] for r in rows}) < 2:
        return weights, bias
    rows = sorted(rows)
    label = np.array([r[0] for r in rows], float)
    docs = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    times, sizes, word = (np.concatenate([np.asarray(r[i], np.int64) for r in rows]) for i in (1, 2, 3))
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    beta, bias = np.zeros(len(slots)), -6.0
    m, v, mb, vb = np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, weights=beta[word], minlength=len(sizes)), -30, 30)))
        clean = np.bincount(docs, weights=times * np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(rows))
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        slope = times * p * (label * (1 - toxic) / toxic - (1 - label))[docs]
        g = np.bincount(word, weights=slope[sentence], minlength=len(slots)) / len(rows) - decay * beta
        gb = slope.sum() / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        beta += fix * m / (np.sqrt(v) + 1e-8)
        bias += fix * mb / (np.sqrt(vb) + 1e-8)
    weights[slots] = beta
    return weights, float(bias)


def _score(weights: np.ndarray, bias: float, located: float):
    def score(batches):
        for batch in batches:
            texts = encoded(batch["text"])
            scores = np.zeros(len(texts))
            found: list[list] = [[] for _ in texts]
            for lo, slots, first, per_doc, start, end in _sentences(texts):
                if not len(first):
                    continue
                p = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(weights[slots].sum(axis=1, dtype=np.float64), first), -30, 30)))
                owner = np.repeat(np.arange(len(per_doc)), per_doc)
                clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(per_doc))
                scores[lo : lo + len(per_doc)] = -np.expm1(clean)
                for i in np.flatnonzero(p >= located).tolist():
                    text = texts[lo + owner[i]]
                    a, b = len(text[: start[i]].decode("utf-8", "ignore")), len(text[: end[i]].decode("utf-8", "ignore"))
                    found[lo + owner[i]].append({"start": a, "end": b, "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            new = {"score": pa.array(np.clip(scores, 0.0, 1.0)), "sentences": pa.array(found, kind)}
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], batch.schema.names)

    return score


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold, at most max_train of them; of rows that share an id the least text.

    The driver gets the telling slots, and of each learned document its distinct sentences as lists of those.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers, so the broadcast has a bound.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = materialize(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    slots = telling_slots(sample)
    kind = "toxic int, times array<int>, sizes array<int>, slots array<int>"
    rows = sample.mapInArrow(_patterns(slots), kind).toArrow() if len(slots) else None
    return fit(list(zip(*(rows[c].to_pylist() for c in rows.column_names))) if rows else [], slots)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], located: float = 0.5) -> DataFrame:
    """docs(text, ...) with score (0 to 1) and sentences: start, end (code points) and score of each at ``located`` or more."""
    out = docs.drop("score", "sentences").select("*", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int,score:double>>").alias("sentences"))
    return out.mapInArrow(_score(*model, located), out.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, train(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))
