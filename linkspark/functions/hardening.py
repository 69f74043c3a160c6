"""Hardening of bit vectors (arrays of n 64-bit words). Automata run as expressions; the rest in Arrow batches.

Noise is drawn for each record from its own generator, keyed by the seed and the record's id, so that a result does not
depend on the order or partition of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .hashing import JavaRandom, shuffled

WORDS = T.ArrayType(T.LongType())


def rule90(words: Column, n: int) -> Column:
    """Every bit becomes the XOR of its neighbours, around the ends."""
    return bits.xor(bits.up(words, n, True), bits.down(words, n, True), n)


def rule30(words: Column, n: int) -> Column:
    """Every bit becomes the one before it XOR (itself OR the one after it), around the ends."""
    return bits.xor(bits.up(words, n, True), bits.or_(words, bits.down(words, n, True), n), n)


def unpacked(words) -> np.ndarray:
    return np.unpackbits(np.asarray(words, dtype="<i8").view(np.uint8), bitorder="little")


def packed(b: np.ndarray) -> list[int]:
    return np.packbits(b.astype(np.uint8), bitorder="little").view("<i8").tolist()


def each(words: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """f over the 0/1 array of every vector; null stays null. Results must be of whole words."""

    @F.pandas_udf(WORDS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else packed(f(unpacked(w))))

    return run(words)


def draws(seed: int, rid: str, m: int) -> np.ndarray:
    key = hashlib.sha256(f"{seed}:{rid}".encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(key[:16], "big"))).random(m)


def noised(words: Column, rid: Column, seed: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    @F.pandas_udf(WORDS)
    def run(s: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for w, i in zip(s, ids, strict=True):
            b = None if w is None else unpacked(w)
            out.append(None if b is None else packed(f(b, draws(seed, i, len(b)))))
        return pd.Series(out)

    return run(words, rid.cast("string"))


def randomized_response(words: Column, rid: Column, p: float, seed: int) -> Column:
    """A bit stays with probability 1 - p, is set with p / 2, cleared with p / 2."""
    return noised(words, rid, seed, lambda b, r: np.where(r <= 1 - p, b, r <= 1 - p / 2))


def flip(words: Column, rid: Column, p: float, seed: int) -> Column:
    return noised(words, rid, seed, lambda b, r: b ^ (r <= p))


def noise(words: Column, rid: Column, value: bool, p: float, seed: int) -> Column:
    """A bit takes `value` with probability p."""
    return noised(words, rid, seed, lambda b, r: np.where(r <= p, value, b))


def balanced(words: Column, n: int, seed: int) -> Column:
    """The vector and its complement, their 16 n bytes shuffled; 2 n words."""
    order = np.array(shuffled(16 * n, seed))
    return each(words, lambda b: np.concatenate([b, 1 - b]).reshape(-1, 8)[order].reshape(-1))


def window_xor(words: Column, window: int) -> Column:
    """A sliding window is XORed with the window one further; each step sees the steps before."""
    if window < 1:
        raise ValueError("a window holds at least one bit")

    def one(b: np.ndarray) -> np.ndarray:
        b, m = b.copy(), len(b)
        for at in range(m - window):
            b[at : at + window] ^= b[at + 1 : at + 1 + window].copy()
        return b

    return each(words, one)


def resampled(words: Column, n: int, seed: int) -> Column:
    """Bit i becomes the XOR of two drawn positions, the same two for all records."""
    r = JavaRandom(seed)
    pairs = np.array([[r.next_int(64 * n), r.next_int(64 * n)] for _ in range(64 * n)])
    return each(words, lambda b: b[pairs[:, 0]] ^ b[pairs[:, 1]])


def rehashed(words: Column, n: int, window: int, step: int, k: int, size: int, seed: int) -> Column:
    """Every window that ends before the last bit gives k positions below size (a multiple of 64) from its own generator."""
    if size % 64:
        raise ValueError("the size is a multiple of 64")
    starts = range(0, 64 * n - window, step)
    seeds = [JavaRandom(seed + i).next_int() for i in range(len(starts))]
    weights = [1 << j for j in range(min(window, 64))]

    def one(b: np.ndarray) -> np.ndarray:
        out = np.zeros(size, dtype=np.uint8)
        for at, s in zip(starts, seeds, strict=True):
            value = sum(w for w, x in zip(weights, b[at : at + 64].tolist(), strict=False) if x)
            r = JavaRandom(s + (value - (1 << 64) if value >> 63 else value))
            out[[r.next_int(size) for _ in range(k)]] = 1
        return out

    return each(words, one)


def two_step(filters: Column, m: int) -> Column:
    """The set of ints of k filters (an array of k arrays of positions below m): each bit column seeds one int."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for rows in s:
            column = [0] * m
            for i, held in enumerate([] if rows is None else rows):
                for p in set(held):
                    column[p] |= 1 << (i % 64)
            value = [(v - (1 << 64) if v >> 63 else v) * (c + 1) for c, v in enumerate(column) if v]
            out.append(None if rows is None else sorted({JavaRandom(v).next_int(2**31 - 1) for v in value}))
        return pd.Series(out)

    return run(filters)
