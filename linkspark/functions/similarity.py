"""Similarities of strings, sets, bit vectors and count vectors, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import qgrams


def guarded(a: Column, b: Column, value: Column) -> Column:
    """0 if either text is null or empty, 1 if they are equal."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(value.cast("double"))


def exact(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    return guarded(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro's similarity, raised by a tenth of the rest for each of up to 4 equal first letters from 0.7 on."""
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro) if jaro >= 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def jaro_winkler(a: Column, b: Column) -> Column:
    return guarded(a, b, jaro_winkler_udf(a, b))


def set_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))).cast("double"), F.lit(0.0))


def jaccard_of_distinct(a: Column, b: Column) -> Column:
    """As set_jaccard, of arrays without repetitions: their intersection is made once, and no union."""
    inter = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(inter, F.size(a) + F.size(b) - inter).cast("double"), F.lit(0.0))


def set_dice(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)).cast("double"), F.lit(0.0))


def set_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))).cast("double"), F.lit(0.0))


def set_braun_blanquet(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))).cast("double"), F.lit(0.0))


def qgram(a: Column, b: Column, q: int = 3) -> Column:
    return guarded(a, b, set_jaccard(F.array_distinct(qgrams(q)(a)), F.array_distinct(qgrams(q)(b))))


def character_jaccard(a: Column, b: Column) -> Column:
    return guarded(a, b, set_jaccard(F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))))


def longer_shorter(a: Column, b: Column) -> tuple[Column, Column]:
    swap = F.char_length(a) < F.char_length(b)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def containment(a: Column, b: Column) -> Column:
    x, y = longer_shorter(a, b)
    return guarded(a, b, F.contains(x, y))


def prefix(a: Column, b: Column) -> Column:
    x, y = longer_shorter(a, b)
    return guarded(a, b, F.startswith(x, y))


def suffix(a: Column, b: Column) -> Column:
    x, y = longer_shorter(a, b)
    return guarded(a, b, F.endswith(x, y))


def ones(words: Column, n: int) -> Column:
    """Cardinality of a bit vector of n words of 64 bits, as one generated expression."""
    return sum((F.bit_count(F.element_at(words, i)) for i in range(1, n + 1)), F.lit(0))


def both(a: Column, b: Column, n: int) -> Column:
    return sum((F.bit_count(F.element_at(a, i).bitwiseAND(F.element_at(b, i))) for i in range(1, n + 1)), F.lit(0))


def binary(kind: str, common: Column, ca: Column, cb: Column) -> Column:
    """Similarity from the cardinalities of a, b and a AND b; empty vectors are no evidence and give 0."""
    value = {
        "jaccard": F.try_divide(common, ca + cb - common),
        "dice": F.try_divide(2 * common, ca + cb),
        "cosine": F.try_divide(common, F.sqrt(ca) * F.sqrt(cb)),
        "braun_blanquet": F.try_divide(common, F.greatest(ca, cb)),
        "overlap": F.try_divide(common, F.least(ca, cb)),
        "strict_overlap": F.when(F.try_divide(common, F.least(ca, cb)) < 1, F.lit(0.0)).otherwise(F.lit(1.0)),
    }[kind]
    return F.coalesce(value.cast("double"), F.lit(0.0))


def words_of(positions: Column, n: int) -> Column:
    """n words of 64 bits, little-endian, from an array of distinct positions."""
    one = lambda w: F.aggregate(F.filter(positions, lambda p: F.floor(p / 64) == w), F.lit(0).cast("bigint"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(64)).cast("int"))))
    return F.array(*(one(w) for w in range(n)))


def folded(words: Column, n: int, times: int = 1) -> Column:
    """The first half XOR the second, `times` times; n words."""
    for _ in range(times):
        n //= 2
        words = F.array(*(F.element_at(words, i).bitwiseXOR(F.element_at(words, i + n)) for i in range(1, n + 1)))
    return words


def counts_v1(a: Column, b: Column) -> Column:
    z = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return F.try_divide(z(lambda x, y: F.when((x > 0) & (y > 0), x + y).otherwise(0)), z(lambda x, y: x + y))


def counts_v2(a: Column, b: Column) -> Column:
    z = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return F.try_divide(z(lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), z(lambda x, y: F.when((x > 0) | (y > 0), 1).otherwise(0)))


def classify(similarity: Column, upper: float, lower: float | None = None) -> Column:
    """DEFINITE_MATCH, POSSIBLE_MATCH, NON_MATCH; UNKNOWN for null, and no evidence (NaN) is no match."""
    possible = F.lit(False) if lower is None else similarity >= lower
    return F.when(similarity.isNull(), F.lit("UNKNOWN")).when(F.isnan(similarity), F.lit("NON_MATCH")).when(similarity >= upper, F.lit("DEFINITE_MATCH")).when(possible, F.lit("POSSIBLE_MATCH")).otherwise(F.lit("NON_MATCH"))
