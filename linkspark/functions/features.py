"""Feature extraction: Column -> Column of an array of strings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hashing

Extractor = Callable[[Column], Column]


def qgrams(q: int, pad: str = "") -> Extractor:
    """Substrings of q characters, with q - 1 pads at either end if pad is given; a shorter text is its only gram."""

    def run(c: Column) -> Column:
        s = F.concat(F.lit(pad * (q - 1)), c, F.lit(pad * (q - 1))) if pad else c
        return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(s) - q + 1)), lambda i: F.substring(s, i, F.lit(q))))

    return run


def special_trigrams(pad: str = "") -> Extractor:
    """Trigrams; of three padded ones the first alone, and of a single unpadded one none."""

    def run(c: Column) -> Column:
        g = qgrams(3, pad)(c)
        return F.when(F.size(g) == 3, F.slice(g, 1, 1)).otherwise(g) if pad else F.when(F.size(g) == 1, F.slice(g, 1, 0)).otherwise(g)

    return run


def constant_weight_trigrams(salt: str, least: int, most: int, pad: str = "#") -> Extractor:
    """Distinct trigrams, between `least` and `most` of them: the smallest by a keyed hash, or filled with hashed tokens."""

    def run(c: Column) -> Column:
        return F.when(F.trim(c) == "", F.array(c)).when(c.isNull(), F.expr("cast(array() as array<string>)")).otherwise(hashing.constant_weight(c, F.array_distinct(qgrams(3, pad)(c)), salt, least, most))

    return run


def identity(c: Column) -> Column:
    return F.array(c)


def substring(begin: int, end: int) -> Extractor:
    """Characters begin to end - 1 (clamped); an empty text gives itself, a begin beyond the text nothing."""
    none = F.expr("cast(array() as array<string>)")
    return lambda c: F.when(c == "", F.array(c)).when(F.char_length(c) < begin, none).otherwise(F.array(F.substring(c, begin + 1, max(0, end - begin))))


def split_by(pattern: str) -> Extractor:
    """Parts between matches, without empty ones at the end."""

    def run(c: Column) -> Column:
        s = F.split(c, pattern)
        last = F.aggregate(F.sequence(F.lit(1), F.size(s)), F.lit(0), lambda a, i: F.when(F.element_at(s, i) != "", i).otherwise(a))
        return F.slice(s, F.lit(1), last)

    return run


def integer_range(start: int, end: int, reach: int) -> Extractor:
    """The number, then its neighbours up to `reach` above and below, wrapping from end to start."""

    def run(c: Column) -> Column:
        v, n = c.cast("int"), end - start + 1
        wrap = lambda x: F.pmod(x - start, F.lit(n)) + start
        near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.array(wrap(v + i), wrap(v - i))))
        return F.transform(F.concat(F.array(v), near), lambda x: x.cast("string"))

    return run


def min_hash(seed: int, extractor: Extractor) -> Extractor:
    """The least of the hashes md5 + s * sha1 (32-bit, wrapping) of the features; s is the seed's first random int."""
    s = hashing.java_ints(seed, 1)[0]
    one = lambda g: hashing.wrap32(hashing.int_of(F.md5(g)) + s * hashing.int_of(F.sha1(g)))
    return lambda c: F.array(F.array_min(F.transform(extractor(c), one)).cast("string"))


def chain(*extractors: Extractor) -> Extractor:
    return lambda c: F.concat(*(e(c) for e in extractors))


def features(columns: Sequence[str], extractors: Sequence[Extractor], known: Sequence[str]) -> Column:
    """All features of all columns that are known, one after the other."""
    return F.flatten(F.array(*(e(F.col(c)) for c in columns if c in known for e in extractors)))


def soundex(c: Column) -> Column:
    return F.array(F.soundex(c))
