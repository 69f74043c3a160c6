"""Bit vectors as arrays of n signed 64-bit words, bit 0 lowest, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import both, ones

BIG = "bigint"


def word(words: Column, i: int) -> Column:
    return F.element_at(words, i + 1)


def wordwise(n: int, f: Callable[..., Column], *vectors: Column) -> Column:
    return F.array(*(f(*(word(v, i) for v in vectors)) for i in range(n)))


def and_(a: Column, b: Column, n: int) -> Column:
    return wordwise(n, lambda x, y: x.bitwiseAND(y), a, b)


def or_(a: Column, b: Column, n: int) -> Column:
    return wordwise(n, lambda x, y: x.bitwiseOR(y), a, b)


def xor(a: Column, b: Column, n: int) -> Column:
    return wordwise(n, lambda x, y: x.bitwiseXOR(y), a, b)


def and_not(a: Column, b: Column, n: int) -> Column:
    """a without the bits of the mask b."""
    return wordwise(n, lambda x, y: x.bitwiseAND(F.bitwise_not(y)), a, b)


def not_(a: Column, n: int) -> Column:
    return wordwise(n, F.bitwise_not, a)


def nand(a: Column, b: Column, n: int) -> Column:
    return not_(and_(a, b, n), n)


def nor(a: Column, b: Column, n: int) -> Column:
    return not_(or_(a, b, n), n)


def up(a: Column, n: int, cyclic: bool = False) -> Column:
    """Every bit one position higher; the highest is lost or, if cyclic, becomes the lowest."""
    carry = lambda i: F.shiftrightunsigned(word(a, i), 63) if i >= 0 else (F.shiftrightunsigned(word(a, n - 1), 63) if cyclic else F.lit(0).cast(BIG))
    return F.array(*(F.shiftleft(word(a, i), 1).bitwiseOR(carry(i - 1)) for i in range(n)))


def down(a: Column, n: int, cyclic: bool = False) -> Column:
    """Every bit one position lower; the lowest is lost or, if cyclic, becomes the highest."""
    carry = lambda i: F.shiftleft(word(a, i), 63) if i < n else (F.shiftleft(word(a, 0), 63) if cyclic else F.lit(0).cast(BIG))
    return F.array(*(F.shiftrightunsigned(word(a, i), 1).bitwiseOR(carry(i + 1)) for i in range(n)))


def has(words: Column, position: int) -> Column:
    return F.shiftrightunsigned(word(words, position // 64), position % 64).bitwiseAND(F.lit(1).cast(BIG)) == 1


def positions(words: Column, n: int) -> Column:
    """The set positions, ascending."""
    at = lambda p: F.call_function("shiftrightunsigned", F.element_at(words, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int"))
    return F.filter(F.sequence(F.lit(0), F.lit(64 * n - 1)), lambda p: at(p).bitwiseAND(F.lit(1).cast(BIG)) == 1)


def short_string(words: Column, n: int) -> Column:
    return F.array_join(positions(words, n), ",")


def gathered(rows: DataFrame, by: list[str], position: str, n: int) -> DataFrame:
    """by, words: the vector of each group's positions, by partial aggregates of n words, without lists of positions."""
    p = F.col(position).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast(BIG), F.pmod(p, F.lit(64)))
    x = rows.groupBy(*by).agg(*(F.bit_or(F.when(F.floor(p / 64) == i, one)).alias(f"__w{i}") for i in range(n)))
    return x.select(*by, F.array(*(F.coalesce(f"__w{i}", F.lit(0).cast(BIG)) for i in range(n))).alias("words"))


def hex_bytes(words: Column, n: int) -> Column:
    """Two hexadecimal digits a byte, lowest byte first."""
    byte = lambda i, j: F.lpad(F.hex(F.shiftrightunsigned(word(words, i), 8 * j).bitwiseAND(F.lit(255).cast(BIG))), 2, "0")
    return F.concat(*(byte(i, j) for i in range(n) for j in range(8)))


def to_base64(words: Column, n: int) -> Column:
    """Base64 of the bytes, lowest first, without trailing zero bytes: the payload format."""
    return F.base64(F.unhex(F.regexp_replace(hex_bytes(words, n), "(00)+$", "")))


def from_base64(text: Column, n: int) -> Column:
    """The words of a payload; missing high bytes are zero."""
    digits = F.rpad(F.hex(F.unbase64(text)), 16 * n, "0")
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast(BIG)

    def one(i: int) -> Column:
        out = byte(8 * i)
        for j in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(byte(8 * i + j), 8 * j))
        return out

    return F.array(*(one(i) for i in range(n)))


def binary_string(words: Column, n: int, little: bool = True) -> Column:
    """m digits, the lowest position first (little) or last."""
    digits = F.concat(*(F.lpad(F.bin(word(words, i)), 64, "0") for i in reversed(range(n))))
    return F.reverse(digits) if little else digits


def pair_counts(a: Column, b: Column, n: int) -> Column:
    """struct(c00, c01, c10, c11): positions by their bit in a and in b."""
    x, y, c = ones(a, n), ones(b, n), both(a, b, n)
    return F.struct((64 * n - x - y + c).alias("c00"), (y - c).alias("c01"), (x - c).alias("c10"), c.alias("c11"))


def length(words: Column, n: int) -> Column:
    """The highest set position plus 1; 0 for none."""
    out = F.lit(0)
    for i in range(n):
        out = F.when(word(words, i) != 0, 64 * i + F.char_length(F.bin(word(words, i)))).otherwise(out)
    return out


def hamming_distance(a: Column, b: Column, n: int, normalized: bool = False) -> Column:
    """Positions that differ, or their share of the larger cardinality."""
    x = ones(xor(a, b, n), n)
    return F.coalesce(F.try_divide(x, F.greatest(ones(a, n), ones(b, n))).cast("double"), F.lit(0.0)) if normalized else x


def hamming_similarity(a: Column, b: Column, n: int) -> Column:
    """1 less the positions that differ by the larger length; 0 for two empty vectors."""
    return F.coalesce(1 - F.try_divide(ones(xor(a, b, n), n), F.greatest(length(a, n), length(b, n))), F.lit(0.0))


def folding_similarity(a: Column, b: Column, ca: Column, cb: Column, n: int, tight: bool = False) -> Column:
    """Similarity of folded vectors of which the cardinalities before folding are known."""
    x = F.abs(ones(a, n) - ones(b, n)) if tight else ones(xor(a, b, n), n)
    return F.coalesce(F.try_divide(ca + cb - x, ca + cb + x).cast("double"), F.lit(0.0))


def information_gain(counts: Column) -> Column:
    """log2(l) plus the sum of p log2 p over the l counts of a filter."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)
    terms = F.transform(counts, lambda v: F.when(v > 0, v / total * F.log2(v / total)).otherwise(0.0))
    return F.log2(F.size(counts)) + F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
