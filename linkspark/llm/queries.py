"""The queries of the training-data operators over the whole tables of a folder, and the SQL of those that it can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, lattice, minhash, neighbours, packing, secrets, simhash, suffix, tokencount
from .common import cut, fresh_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048, 0)


def op2_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_simhash(spark, sf_dir):
    """near_found, for ids divisible by 50: other documents whose fingerprint differs in at most 27 bits."""
    made = cut(simhash.fingerprints(table(spark, sf_dir, "documents")))
    found = simhash.within(made.select("high", "low"), made.where("doc_id % 50 = 0").select("doc_id", "high", "low"), simhash.RADIUS)
    found = found.groupBy(F.col("doc_id").alias("asked")).agg(F.max("near_found").alias("near_found"))
    return made.join(found, F.col("doc_id") == F.col("asked"), "left").drop("high", "low", "asked")


def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def markov(spark, sf_dir):
    """The model of op6: random strings against identifiers made of the benchmark's words."""
    ordinary = secrets.ordinary_strings(table(spark, sf_dir, "benchmark").select("text"), secrets.SAMPLE)
    return secrets.fit(secrets.random_strings(spark, secrets.SAMPLE).union(ordinary))


def op6_secrets(spark, sf_dir):
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents"), markov(spark, sf_dir)))


def op7_repeats(spark, sf_dir):
    """Every document that holds a passage of 50 words found elsewhere too: its spans, and those to cut."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    found = suffix.repeats(table(spark, sf_dir, "documents"), 50)
    size = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.size("repeats").cast("long").alias("n_repeats"), listed("repeats").alias("repeats"), listed("cuts").alias("cuts"), size.alias("cut_chars"))


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"), "rejected")


def op9_pieces(spark, sf_dir):
    return lattice.segment(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4)


def op10_tokens(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), fresh_path(spark, "token-counts"), limit=4096)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    made = (op1_pack, op2_chat, op3_simhash, op4_minhash, op5_neighbours, op6_secrets, op7_repeats, op8_language, op9_pieces, op10_tokens)
    return {f.__name__: f for f in made} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.SQL}
