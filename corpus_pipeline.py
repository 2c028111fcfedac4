"""From raw documents to token ids: toxicity, near-dedup, personal data, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  Near-duplicates are documents whose sets of five-word shingles are 0.8 similar (Jaccard) or
more: the SimHash operator at a similarity, whose bit-sliced search proposes the pairs that intersections decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundleloom.llm import jaccard, mixing, pii, sentencepiece, toxicity
from bundleloom.llm.common import stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels' training fold."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return jaccard.keep_one(docs, width=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its token ids and their number."""
    out = sentencepiece.encode(docs, sentencepiece.load())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", clean), ("simhash_near_dedup", near_dedup), ("pii", private), ("mixing", mixed), ("sentencepiece", coded)]

#: SQL can't express the learned and hashed stages; the tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
