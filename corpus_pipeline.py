"""Cleaning pipeline over documents: toxicity, near duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; it is written as
Parquet and read again as the next one's docs. The last one also returns size, source_size, target and copies of each
document and the number of the copy. Rows without an id pass the stages that compare documents by id.
Tables of no rows give no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialize
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.minhash_dedup import mark_of, near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.secrets import redact
from tidemark.llm.toxicity import score_toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half."""
    model = train(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: of its least id, and of that the least hash of the text.

    Rows are told apart by id and text. Of equal rows with an id and with words one stays; rows without an id or
    without words are no duplicates of anything and stay.
    """
    key = ["doc_id", "_mark_of_text"]
    marked = docs.withColumn("_mark_of_text", mark_of("text"))
    compared = F.col("doc_id").isNotNull() & F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    repeated = near_duplicates(docs).where("not is_first").select("doc_id", F.col("mark").alias("_mark_of_text")).distinct()
    # The aggregate and the join share one partitioning by the key.
    kept = marked.where(compared).dropDuplicates(key).join(repeated, key, "left_anti")
    return kept.unionByName(marked.where(~compared)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return find_contamination(docs, load(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it; copy counts from 1."""
    mixed = mix(docs).where("copies > 0")
    return mixed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Trained scores, sampled signatures and random rounding have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
