"""Links of whole texts against brute force, and of texts that a prefix would link or miss."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkspark import catalog
from linkspark.operators import similar


def body(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789_") for _ in range(n))


OPENING, A, B = body(300, 1), body(1500, 2), body(1500, 3)
#: 1 and 2 share an opening only, 1 and 3 all but the opening; 4 and 5 are short and equal, 6 and 7 empty.
TEXTS = {1: OPENING + A, 2: OPENING + B, 3: body(30, 4) + OPENING[30:] + A, 4: "abc", 5: "abc", 6: "", 7: None, 8: A + "end", 9: B[:1000] + body(500, 5)}


def edited(seed: int) -> str:
    r, s = random.Random(seed), list(body(400, 9))
    for at in r.sample(range(400), r.randint(0, 16)):
        s[at] = "#"
    return "".join(s)


def brute(texts: dict) -> dict:
    g = {i: set(similar.grams(t).tolist()) for i, t in texts.items() if t}
    return {(a, b): s for a in g for b in g if a < b and (s := len(g[a] & g[b]) / len(g[a] | g[b])) >= 0.7}


def test_pairs_of_whole_texts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    texts = TEXTS | {100 + i: edited(i) for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "rid long, norm string")
    members, links = similar.similar_classes(d, 0.7)
    pairs, cls = similar.between(members, members, links).collect(), {x.rid: x.cls for x in members.collect()}
    want = brute(texts)
    smallest = {c: min(i for i in cls if cls[i] == c) for c in cls.values()}
    got = {(a, b): x.sim for x in pairs for a in cls for b in cls if a < b and {smallest[cls[a]], smallest[cls[b]]} == {x.l, x.r}}
    assert sum(x.n for x in pairs) == 2 * len(want) + len(cls)
    assert (1, 3) in want and (4, 5) in want and (1, 2) not in want
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_queries_see_whole_texts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    d = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in TEXTS.items()], "doc_id long, text string, source string")
    d.withColumn("source", F.when(F.col("doc_id") == 1, "a").otherwise("b")).write.parquet(str(tmp_path / "documents.parquet"))
    for f in (catalog.link_whole_documents, catalog.incremental_links):
        got = {x.rid: x.cluster_id for x in f(spark, str(tmp_path)).collect()}
        assert len(got) == len(TEXTS) and got[1] == got[3] == got[8] and got[4] == got[5] and got[2] != got[1], f.__name__
        assert got[6] != got[7] and got[9] == 9
