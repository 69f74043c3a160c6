"""Blocking keys of bit vectors: an array of one key a function, to be exploded with its position as key_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .hardening import unpacked
from .hashing import JavaRandom, shuffled


def jaccard_keys(words: Column, size: int, keys: int, m: int, seed: int, separator: str = ",") -> Column:
    """Min-hash bands: each component is the first set position in a seeded permutation; an empty vector has no key.

    Without a separator keys are those of implementations that join the components plainly, with more false candidates.
    """
    orders = [[np.array(shuffled(m, seed + j + seed * k)) for j in range(size)] for k in range(keys)]

    def one(b: np.ndarray) -> list[str]:
        return [separator.join(str(o[b[o].argmax()]) for o in band) for band in orders]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: [] if w is None or not any(w) else one(unpacked(w)))

    return run(words)


def sampled_positions(size: int, keys: int, m: int, seed: int) -> list[list[int]]:
    """size * keys distinct positions below m, dealt to the keys."""
    if size * keys > m:
        raise ValueError(f"{size * keys} distinct positions need at least as many bits; there are {m}")
    r, found = JavaRandom(seed), {}
    while len(found) < size * keys:
        found.setdefault(r.next_int(m))
    flat = list(found)
    return [flat[i * size : (i + 1) * size] for i in range(keys)]


def restricted_positions(vectors: DataFrame, column: str, size: int, keys: int, m: int, seed: int, share: float) -> list[list[int]]:
    """Positions drawn, with repeats, from those that are neither among the rarest nor the most frequent share.

    At most m counts reach the driver. Positions that are set nowhere count as rarest; ties go to the smaller position.
    """
    cut = int(m * share)
    if cut < size * keys or 2 * cut >= m:
        raise ValueError("too many or too large keys for the pruned share")
    n = vectors.select(F.explode(bits.positions(F.col(column), m // 64)).alias("p")).groupBy("p").count().collect()
    count = {r.p: r["count"] for r in n}
    kept = sorted(range(m), key=lambda p: (count.get(p, 0), p))[cut : m - cut]
    r = JavaRandom(seed)
    flat = [kept[r.next_int(len(kept))] for _ in range(size * keys)]
    return [flat[i * size : (i + 1) * size] for i in range(keys)]


def hamming_keys(words: Column, drawn: list[list[int]]) -> Column:
    """Each key lists which of its drawn positions are set."""
    return F.array(*(F.concat_ws(",", *(F.when(bits.has(words, p), F.lit(str(i))) for i, p in enumerate(group))) for group in drawn))


def key_table(records: DataFrame, keys: Column) -> DataFrame:
    """rid, key_id, key_value."""
    return records.select("rid", F.posexplode(keys).alias("key_id", "key_value"))
