"""A training corpus from `documents`: language, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; each result is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import langid, minhash, packing, queries, secrets, suffix
from linkspark.llm.common import fresh_path

MODEL = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter, or no language's dictionary codes the text much better."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one of the smallest doc_id: rows count, not ids."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words found before are cut from the text."""
    return suffix.without_repeats(docs, 50).withColumn("n_chars", F.char_length("text").cast("long"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by [SECRET]."""
    model = queries.markov(spark, sf_dir)
    found = secrets.scan(docs, model, keep=docs.columns)
    text = F.when(F.col("text").isNotNull(), secrets.masked(F.col("text"), F.col("__spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, at its place in sequences of at most 2048."""
    return packing.pack(docs, queries.tokenizer(MODEL), 2048, 0)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: The stages learn dictionaries and models and solve a linear program, which SQL can't say; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
