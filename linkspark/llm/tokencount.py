"""Token counts through a digest cache."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_digest, path_exists, texts
from .tokenizing import counter


def cached(spark, cache_path: str, version: str) -> DataFrame:
    """The counts stored for one tokenizer version: digest, n_tokens, a digest that two writers stored once only."""
    at = f"{cache_path}/version={version}"
    if not path_exists(spark, at):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema("digest binary, n_tokens long").parquet(at).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Content is normalised (null becomes empty; a tokenizer sees everything else) and digested with SHA-256; the digest
    of the tokenizer's file is the version. Digests without a stored count are encoded once each and appended to the
    cache by Spark's committer (a lost executor leaves no half file; what two writers both store counts once), then all rows are
    joined to it. Texts of copies meet as digests first within a task, so that a group of copies is one row of the
    shuffle per task. Null and empty texts have 0 tokens; repeated rows give repeated rows; an empty table gives none.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)[:16]
    rows = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = cached(spark, cache_path, version)
    misses = rows.select("digest", "text")
    if path_exists(spark, f"{cache_path}/version={version}"):
        misses = misses.join(stored.select("digest"), "digest", "left_anti")
    misses = misses.dropDuplicates(["digest"])

    def encode(batches):
        c = counter(tokenizer_path)
        for b in batches:
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    misses.mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(f"{cache_path}/version={version}")
    stored = cached(spark, cache_path, version)
    return (
        rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(stored, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
