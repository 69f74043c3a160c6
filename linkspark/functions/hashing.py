"""Digests, keyed hashes and seeded generators with the results of the Java class library."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The key and tokens of deterministic hashing.
KEY = b"PRIMAT_DETERMINISTIC"
FILL, MISSING_TOKEN, MISSING_BUCKET = "CWE_FILL_", "MISSING_T", "MISSING_B"
MAX_INT = 2**31 - 1


class JavaRandom:
    """The linear congruential generator of java.util.Random: state * 0x5DEECE66D + 11 modulo 2**48."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 11) & (1 << 48) - 1
        x = self.state >> (48 - n)
        return x - (1 << n) if n == 32 and x >> 31 else x

    def next_int(self, bound: int | None = None) -> int:
        return self.bits(32) if bound is None else bounded(self.bits, bound)

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)


class Sha1Random:
    """SecureRandom's SHA1PRNG from a seed: output is SHA-1 of the state, and the state grows by output and 1."""

    def __init__(self, seed: int):
        self.state = hashlib.sha1((seed & (1 << 64) - 1).to_bytes(8, "little")).digest()
        self.rest = b""

    def bits(self, n: int) -> int:
        size = (n + 7) // 8
        out = b""
        while len(out) < size:
            if not self.rest:
                made = hashlib.sha1(self.state).digest()
                carry, new = 1, bytearray(20)
                for i in range(20):  # byte by byte, as signed bytes, the carry of an arithmetic shift
                    v = signed_byte(self.state[i]) + signed_byte(made[i]) + carry
                    new[i] = v & 0xFF
                    carry = v >> 8
                if bytes(new) == self.state:
                    new[0] = (new[0] + 1) & 0xFF
                self.state, self.rest = bytes(new), made
            k = size - len(out)
            out, self.rest = out + self.rest[:k], self.rest[k:]
        return int.from_bytes(out, "big") >> (8 * size - n)

    def next_int(self, bound: int) -> int:
        return bounded(self.bits, bound)


def signed_byte(b: int) -> int:
    return b - 256 if b > 127 else b


def bounded(bits, bound: int) -> int:
    """nextInt(bound) of the class library: powers of two by the high bits, others by rejection."""
    x = bits(31)
    if bound & (bound - 1) == 0:
        return (bound * x) >> 31
    while x - x % bound + bound - 1 > MAX_INT:
        x = bits(31)
    return x % bound


def java_ints(seed: int, n: int) -> list[int]:
    r = JavaRandom(seed)
    return [r.next_int() for _ in range(n)]


def shuffled(n: int, seed: int) -> list[int]:
    """Collections.shuffle of 0 to n - 1."""
    out, r = list(range(n)), JavaRandom(seed)
    for i in range(n, 1, -1):
        j = r.next_int(i)
        out[i - 1], out[j] = out[j], out[i - 1]
    return out


def keyed_seed(key: str, token: str) -> int:
    """The first 8 bytes of HMAC-SHA384, as a signed long."""
    return int.from_bytes(hmac.digest(key.encode(), token.encode(), "sha384")[:8], "big", signed=True)


def random_positions(token: str, k: int, m: int, key: str = "SECRET", secure: bool = True) -> list[int]:
    r = (Sha1Random if secure else JavaRandom)(keyed_seed(key, token))
    return [r.next_int(m) for _ in range(k)]


def positive_int(value: str) -> int:
    """The first int of HMAC-SHA384, its absolute value modulo the largest int."""
    return abs(int.from_bytes(hmac.digest(KEY, value.encode(), "sha384")[:4], "big", signed=True)) % MAX_INT


@F.pandas_udf(T.IntegerType())
def positive_ints(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else positive_int(x)).astype("Int32")


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(positive_ints(c), F.lit(buckets))


def random_hashes(c: Column, k: int, m: int, key: str = "SECRET", secure: bool = True) -> Column:
    """k positions below m from a generator seeded by the token's keyed hash."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else random_positions(x, k, m, key, secure))

    return run(c)


def constant_weight(value: Column, grams: Column, salt: str, least: int, most: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series, sets: pd.Series) -> pd.Series:
        out = []
        for v, g in zip(values, sets, strict=True):
            g = None if g is None else list(g)
            if g is not None and len(g) > most:
                g = sorted(g, key=lambda x: (positive_int(x + salt), x))[:most]
            elif g is not None:
                i = 0
                while len(g) < least and i < 10 * least:
                    t = f"{FILL}{positive_int(f'{v}{salt}_{i}')}"
                    if t not in g:
                        g.append(t)
                    i += 1
            out.append(g)
        return pd.Series(out)

    return run(value, grams)


def missing_tokens(anchor: Column, k: int) -> Column:
    """k tokens for a missing value, the same for all records whose anchor falls into one of 64 buckets."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        one = lambda x: [f"{MISSING_TOKEN}{positive_int(f'{MISSING_BUCKET}{positive_int(x) % 64}_{i}')}" for i in range(k)]
        return s.map(lambda x: None if x is None else one(x))

    return run(anchor)


def wrap32(c: Column) -> Column:
    """A long as a signed 32-bit int."""
    return F.pmod(c + 2**31, F.lit(2**32)) - 2**31


def int_of(hex_digest: Column) -> Column:
    """The first four bytes of a digest, big-endian, as a signed int (in a long)."""
    return wrap32(F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint"))


def position(h: Column, m: int) -> Column:
    """A position below m; the least int, which has no absolute value, counts as 0."""
    h = wrap32(h)
    return (F.when(h == -(2**31), F.lit(0)).otherwise(F.abs(h)) % m).cast("int")


def double_hashes(token: Column, k: int, m: int, enhanced: bool = False) -> Column:
    """h1 + i h2 for i < k, from SHA-1 and MD5; enhanced adds (i**3 - i) / 6."""
    h1, h2 = int_of(F.sha1(token)), int_of(F.md5(token))
    more = [(i**3 - i) // 6 if enhanced else 0 for i in range(k)]
    return F.array(*(position(h1 + F.lit(i) * h2 + F.lit(x), m) for i, x in enumerate(more)))


def triple_hashes(token: Column, k: int, m: int) -> Column:
    """h1 + i h2 + i (i - 1) / 2 h3, from SHA-1, MD5 and SHA-256 (the third digest is a parameter of the scheme)."""
    h1, h2, h3 = int_of(F.sha1(token)), int_of(F.md5(token)), int_of(F.sha2(token, 256))
    return F.array(*(position(wrap32(h1 + F.lit(i) * h2) + wrap32(F.lit(i * (i - 1) // 2) * h3), m) for i in range(k)))


#: Digests of standard hashing, in order.
DIGESTS = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}


def standard_hashes(token: Column, k: int, m: int, digests: tuple[str, ...] = tuple(DIGESTS)) -> Column:
    """The i-th position from the i-th digest."""
    if k > len(digests):
        raise ValueError(f"{k} positions need as many digests; there are {len(digests)}")
    return F.array(*(position(int_of(DIGESTS[d](token)), m) for d in digests[:k]))
