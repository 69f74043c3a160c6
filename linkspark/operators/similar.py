"""Pairs of whole texts whose sets of character 8-grams are similar: MinHash keys, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiles

#: Bytes of a gram; 8 are one 64-bit number, so sets of grams are exact.
GRAM = 8
#: 40 bands of 4 minima: a pair at similarity 0.7 shares no band with probability (1 - 0.7**4)**40 = 2e-5.
BANDS, ROWS = 40, 4
U = np.uint64


def grams(text: str) -> np.ndarray:
    """Sorted distinct 8-grams of the text's UTF-8 bytes; a shorter text is one gram, an empty one has none."""
    b = text.encode()
    b = b.ljust(GRAM, b"\0") if b else b
    if not b:
        return np.zeros(0, U)
    return np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), GRAM)).view(U).ravel())


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hashes on the set."""
    r = np.random.default_rng(20240229)
    a, b = r.integers(0, 2**63, BANDS * ROWS, U) * U(2) + U(1), r.integers(0, 2**63, BANDS * ROWS, U)
    s, out = mix(s), np.full(BANDS * ROWS, 2**64 - 1, U)
    for at in range(0, len(s), 128):
        np.minimum(out, (s[at : at + 128, None] * a[None, :] + b[None, :]).min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)


def signed(classes: DataFrame) -> DataFrame:
    """cls, n (grams), signature and keys (one a band) of classes (cls, norm)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for t in part.column("norm").to_pylist():
                    s = grams(t)
                    m = signature(s)
                    keys = [xxhash.xxh3_64_intdigest(m[k * ROWS : k * ROWS + ROWS].tobytes(), seed=k) for k in range(BANDS)]
                    rows.append((len(s), m.tobytes(), np.array(keys, U).view(np.int64).tolist()))
                n, m, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(n, pa.int64()), pa.array(m, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["cls", "n", "signature", "keys"])

    kind = classes.schema["cls"].dataType.simpleString()
    return classes.mapInArrow(run, f"cls {kind}, n long, signature binary, keys array<long>")


@F.pandas_udf(T.DoubleType())
def agreement(a, b):
    """Share of equal minima."""
    import pandas as pd

    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1), dtype="float64")


@F.pandas_udf(T.DoubleType())
def similarity(a, b):
    """Jaccard similarity of the texts' grams."""
    import pandas as pd

    return pd.Series([jaccard(grams(x), grams(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_classes(records: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """members (rid, cls), and (a, b, sim) with a < b of different classes with similarity `least` or more.

    Records (rid, norm) of equal texts are one class, named by its smallest rid; null and empty texts are in none.
    Candidates share a band of the whole text's signature; those whose sizes and minima (5 standard deviations below a
    link's mean) allow a link are verified on all grams.
    """
    conf, size = records.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(size)) <= 1000:
        conf.set(size, 1000)  # a batch of whole texts must fit in a worker's memory
    named = records.where("norm <> ''").select("rid", "norm", F.sha2("norm", 256).alias("digest")).checkpoint()
    first = named.groupBy("digest").agg(F.min("rid").alias("cls"))
    members = named.select("rid", "digest").join(first, "digest").select("rid", "cls").checkpoint()
    classes = named.join(members.where("rid = cls").select("rid"), "rid", "left_semi").select(F.col("rid").alias("cls"), "norm")
    made = signed(classes).checkpoint()
    keys = made.select("cls", F.posexplode("keys").alias("band", "key"))
    shared = keys.select(F.col("cls").alias("a"), "band", "key").join(keys.select(F.col("cls").alias("b"), "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    side = lambda d, v, *c: d.select(F.col("cls").alias(v), *(F.col(x).alias(f"{x}_{v}") for x in c))
    x = shared.join(side(made, "a", "n", "signature"), "a").join(side(made, "b", "n", "signature"), "b")
    share = least - 5 * (least * (1 - least) / (BANDS * ROWS)) ** 0.5
    x = x.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")).where(agreement("signature_a", "signature_b") >= share).select("a", "b").checkpoint()
    x = x.join(side(classes, "a", "norm"), "a").join(side(classes, "b", "norm"), "b")
    return members, x.select("a", "b", similarity("norm_a", "norm_b").alias("sim")).where(F.col("sim") >= least).checkpoint()


def similar_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """l, r: each record with its class, and the linked classes: enough for the components of all similar pairs."""
    return members.where("rid <> cls").select(F.col("cls").alias("l"), F.col("rid").alias("r")).union(links.select(F.col("a").alias("l"), F.col("b").alias("r")))


def between(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """l, r, sim, n: the similar pairs of records of left and right (rid, cls), those of two classes as one row.

    l and r are the smallest rids of the two classes in left and right, n the number of pairs the row stands for.
    """
    count = lambda d, v, c: d.groupBy(F.col("cls").alias(c)).agg(F.min("rid").alias(v), F.count(F.lit(1)).alias(f"n_{v}"))
    x, y = count(left, "l", "a"), count(right, "r", "b")
    same = x.select("a").join(y.select(F.col("b").alias("a")), "a").select("a", F.col("a").alias("b"), F.lit(1.0).alias("sim"))
    both = links.union(links.select("b", "a", "sim")).union(same)
    return both.join(x, "a").join(y, "b").select("l", "r", "sim", (F.col("n_l") * F.col("n_r")).alias("n"))


#: Bits that a short text's trigrams are folded into, in words of 64.
WORDS = 8


def folded_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its distinct trigrams as numbers (a row, filled up with the largest), how many, and WORDS words."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(U) for t in texts]
    found = [p[:-2] << U(42) | p[1:-1] << U(21) | p[2:] for p in points]
    n = np.array([len(x) for x in found])
    known, number = np.unique(np.concatenate(found), return_inverse=True)
    key = np.unique(np.repeat(np.arange(len(texts)), n) * len(known) + number)
    row, number = np.divmod(key, max(1, len(known)))
    n = np.bincount(row, minlength=len(texts))
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    grams_of = np.full((len(texts), max(1, n.max())), len(known))
    grams_of[row, place] = number
    words, bit = np.zeros((WORDS, len(texts)), U), number % (64 * WORDS)
    np.bitwise_or.at(words, (bit // 64, row), U(1) << (bit % 64).astype(U))
    return grams_of, n, words


def joined(rows: dict, parts: list, least: float) -> list[tuple]:
    """l, r: links that join what pairs of similar rows (rid, norm) join in each tile, the smallest rid on one side.

    Each differing bit of two texts is a trigram of one only, so texts with more of these than `least` allows need no
    count; nor do texts that are joined already.
    """
    grams_of, n, words = folded_grams(rows["norm"])
    mark, allowed, out = np.zeros(grams_of.max() + 1, np.uint8), (1 - least) / (1 + least), []
    for left, right in parts:
        inner = left == right
        at = np.array(left if inner else left + right)
        w, own, size, root = np.ascontiguousarray(words[:, at]), grams_of[at], n[at], np.arange(len(at))
        for i in range(len(left)):
            js = slice(0, i) if inner else slice(len(left), None)
            far = sum(np.bitwise_count(w[k, js] ^ w[k, i]).astype(np.uint16) for k in range(WORDS))
            near = np.flatnonzero((far <= allowed * (size[js] + size[i]) + 1e-6) & (root[js] != root[i])) + js.start
            if not len(near):
                continue
            mark[own[i, : size[i]]] = 1
            for some in range(0, len(near), 512):
                j = near[some : some + 512]
                both = mark[own[j]].sum(axis=1, dtype=np.int64)
                j = j[both / (size[j] + size[i] - both) >= least]
                if len(j):
                    root[np.isin(root, root[j])] = root[i]
            mark[own[i, : size[i]]] = 0
        groups: dict = {}
        for k, g in zip(at.tolist(), root.tolist(), strict=True):
            groups.setdefault(g, []).append(rows["rid"][k])
        for g in groups.values():
            first = min(g)
            out += [(first, r) for r in g if r != first]
    return out


def links_in_blocks(records: DataFrame, least: float) -> DataFrame:
    """l, r: links whose components are those of all similar pairs within a block; short distinct texts (rid, norm, block).

    Similar are texts of 3 characters or more with a Jaccard similarity of `least` or more of their trigrams.
    """
    kind = records.schema["rid"].dataType.simpleString()
    return tiles.tiled(records, lambda c, t: joined(c, t, least), f"l {kind}, r {kind}")
