"""Plain versions of what SQL cannot express, and the pipeline on awkward and empty tables."""

import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, PASSAGE, rows
from tidemark.llm.chat import format_conversations, read_back
from tidemark.llm.fingerprint import _GEAR, fingerprints
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.toxicity import held_out, score_toxicity, train

SF = "/root/testdata/sf0.001"


def chunks_by_byte(data: bytes, least=16, normal=48, most=256):
    gear, h, hashes = _GEAR.tolist(), 0, []
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    out, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        for i in range(start + least - 1, end):
            if hashes[i] >> (32 - (7 if i + 1 - start < normal else 3)) == 0:
                end = i + 1
                break
        out.append(data[start:end])
        start = end
    return out


def print_of(text: str) -> dict[int, int]:
    sizes: dict[int, int] = defaultdict(int)
    for chunk in chunks_by_byte(text.encode()):
        sizes[xxhash.xxh3_64_intdigest(chunk)] += len(chunk)
    return sizes


def alike(a, b):
    return sum(min(n, b.get(k, 0)) for k, n in a.items()) / sum(a.values()) if a else float(not b)


def test_fingerprints_match_a_byte_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    ordered = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    for k, (doc, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        own, edited = print_of(text), print_of(text[: len(text) - half] + after[:half])
        assert got[doc]["fingerprint"] == "".join(f"{d:016x}{n:08x}" for d, n in sorted(own.items()))
        assert math.isclose(got[doc]["near_edited"], alike(own, edited)) and math.isclose(got[doc]["near_next"], alike(own, print_of(after)))


def test_toxic_documents_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    told = score_toxicity(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("score", "toxic").toPandas()
    found, toxic = told.score >= 0.5, told.toxic == 1
    assert (found & toxic).sum() / found.sum() > 0.9 and (found & toxic).sum() / toxic.sum() > 0.75
    # A document's score is the noisy-or of its sentences, each scored as a document of its own.
    some = docs.where("doc_id < 300").select("doc_id", "text")
    parts = [(r["doc_id"], s) for r in some.collect() for s in re.split(r"[.!?\n\r]", r["text"] or "")]
    clean: dict = defaultdict(lambda: 1.0)
    for r in score_toxicity(spark.createDataFrame(parts, "doc_id long, text string"), model).collect():
        clean[r["doc_id"]] *= 1 - r["score"]
    for r in score_toxicity(some, model).collect():
        assert abs(r["score"] - (1 - clean[r["doc_id"]])) < 1e-6


def test_near_duplicates_recall_on_whole_documents(spark):
    """Of the pairs of different texts at 0.8 or more of sf0.01, counted over all by shared shingles, at least nine tenths are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")] for r in docs.collect()}
    bags = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in texts.items() if w}
    df = Counter(s for b in bags.values() for s in b)
    idf = {s: 1.25 - 0.25 * math.log(n) / math.log(len(texts)) for s, n in df.items()}
    total = {d: sum(n * idf[s] for s, n in b.items()) for d, b in bags.items()}
    holders = defaultdict(list)
    for d, b in bags.items():
        for s in b:
            if df[s] > 1:
                holders[s].append(d)
    common: dict = defaultdict(float)
    for s, own in holders.items():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[b, a] += min(bags[a][s], bags[b][s]) * idf[s]
    near = [p for p, c in common.items() if c / (total[p[0]] + total[p[1]] - c) >= 0.8 and texts[p[0]] != texts[p[1]]]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    found = sum(got[a] == got[b] for a, b in near)
    print(f"recall {found} of {len(near)}")
    assert len(near) > 10 and found >= 0.9 * len(near)


def test_near_duplicates_ties_and_links(spark):
    texts = [(5, PASSAGE), (3, PASSAGE + " one"), (3, "something else of at least five words"), (9, PASSAGE), (4, PASSAGE + " two"), (4, PASSAGE + " two")]
    out = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r["class_id"] for r in out) == [3] * 6
    assert sum(r["is_first"] for r in out) == 2 and {r["n_links"] > 0 for r in out if r["class_id"] != 3 or r["doc_id"] != 3} == {True}


def written(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        (rows if docs.count() else rows.limit(0)).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    folder = written(spark, tmp_path, docs)
    out = corpus_pipeline.run(spark, folder)
    assert out.count() >= 0 and {c.split()[0] for c in DOCS.split(', ')} <= set(out.columns)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, folder), "edges")
        assert at.columns == docs.columns, name
        if name == "near_duplicates":  # of 1, 7, 7 one; 2 and 10 differ too much from it
            kept = Counter(r["doc_id"] for r in at.collect())
            assert kept[1] == 1 and kept[7] == 0 and kept[None] == 2 and kept[3] == kept[4] == kept[5] == 1


@pytest.mark.parametrize("texts", [["a clean text of several words"] * 4, ["one text here", "other words there"]])
def test_pipeline_keeps_one_row_of_rows_that_share_an_id(spark, texts):
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == len(set(texts))


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, spark.createDataFrame([], DOCS))).count() == 0


def test_long_conversation_round_trip(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} </s> [INST] " * 3) for i in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    row = read_back(format_conversations(df)).first()
    assert [(x["role"], x["text"]) for x in row["turns"]] == [(t[2], t[3]) for t in turns] and list(row["loss"]) == [t[3] for t in turns if t[2] == "assistant"]

