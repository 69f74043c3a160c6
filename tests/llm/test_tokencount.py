"""The digest cache: hits are not encoded again, and what two writers store counts once."""

import pytest

from linkspark.llm import tokencount
from linkspark.llm.common import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_cache_is_used_and_appended_to(spark):
    import sentencepiece

    cache, sp = fresh_path(spark, "cache"), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {1: "one two", 2: "three", 3: "one two", 4: None, 5: "four  five ▁ 日本"}
    table = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    count = lambda ids: sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.count_tokens(table(ids), PIECES, cache).collect())
    want = lambda ids: sorted((i, len(sp.encode(texts[i] or ""))) for i in ids)
    at = f"{cache}/version={tokencount.file_digest(PIECES)[:16]}"
    assert count([1, 2, 3]) == want([1, 2, 3]) and spark.read.parquet(at).count() == 2
    assert count([1, 3, 4, 5]) == want([1, 3, 4, 5]) and spark.read.parquet(at).count() == 4
    assert count([2, 2, 5]) == want([2, 2, 5]) and spark.read.parquet(at).count() == 4
    spark.read.parquet(at).write.mode("append").parquet(at + "-again")
    spark.read.parquet(at + "-again").write.mode("append").parquet(at)  # as a second writer would have left it
    assert spark.read.parquet(at).count() == 8 and count([1, 2, 3, 4, 5]) == want([1, 2, 3, 4, 5])
    spark.read.parquet(at).selectExpr("digest", "n_tokens + 100 as n_tokens").distinct().write.mode("overwrite").parquet(at + "-again")
    spark.read.parquet(at + "-again").write.mode("overwrite").parquet(at)
    assert count([1, 2]) == [(i, n + 100) for i, n in want([1, 2])]  # stored counts are what is joined
