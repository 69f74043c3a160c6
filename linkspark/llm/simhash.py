"""Document fingerprints: SimHash votes of weighted word shingles, and search by permuted block tables."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, cut, mix, shingle_hashes, texts, word_hashes

BITS = 128
#: Rows between two bounds of the order of ids, and the most bounds (8 bytes each, sampled 40 ids for each).
RANGE, RANGES = 128, 20_000


def fingerprint(text: str, words: int = 5) -> np.ndarray:
    """16 bytes: for every bit, the sign of the sum of its votes over the text's word shingles.

    A shingle found n times votes with weight 1 + floor(log2 n). A text of fewer words is one shingle, one without
    words an empty shingle.
    """
    s = shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").split()), words)
    if not len(s):
        s = np.zeros(1, np.uint64)
    s, n = np.unique(s, return_counts=True)
    votes, total = np.zeros(BITS, np.int64), 0
    for at in range(0, len(s), 8192):
        x, w = s[at : at + 8192], n[at : at + 8192]
        bits = np.unpackbits(np.stack([mix(x), mix(x + U(0x632BE59BD9B4E019))], axis=1).view(np.uint8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(x)
        for j in np.flatnonzero(w > 1):
            extra = int(w[j]).bit_length() - 1
            votes += extra * bits[j].astype(np.int64)
            total += extra
    return np.packbits(2 * votes > total)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine that the share of differing bits estimates, 0 at least: 1 for equal ones, 0 for a half of the bits."""
    return max(0.0, float(np.cos(np.pi * int(np.unpackbits(x ^ y).sum()) / BITS)))


def ranged(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with `part` (ranges of doc_id) and `end` (0 or 1): the first row of each range in descending
    order is also the last, with end 1, of the range above it, and that of the highest of the lowest one.

    Bounds come from a sample of ids, at most 40 for each bound; the largest id of each range is all else the driver
    gets. Null ids count as the smallest.
    """
    n = rows.count()
    k = max(1, min(RANGES, n // RANGE))
    share = max(1, min(1_000_000, int(40e6 * k / max(n, 1))))
    ids = np.sort(np.array([r[0] for r in rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share) & F.col("doc_id").isNotNull()).select("doc_id").collect()], np.int64))
    bounds = np.unique(ids[np.linspace(0, len(ids) - 1, k + 1).astype(int)[1:-1]]) if len(ids) > k else ids[:0]

    @F.pandas_udf(T.IntegerType())
    def part(i):
        import pandas as pd

        return pd.Series(np.where(i.isna(), 0, np.searchsorted(bounds, i.fillna(0).to_numpy().astype(np.int64), side="right"))).astype("int32")

    first = sorted((r["part"], r["first"]) for r in rows.select("doc_id", part("doc_id").alias("part")).groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    parts, above = [p for p, _ in first], {}
    for j, (_, i) in enumerate(first):
        if i is not None:
            above[i] = parts[(j + 1) % len(parts)]
    tops = np.array(sorted(above), np.int64)
    where = np.array([above[i] for i in tops.tolist()], np.int64)

    @F.pandas_udf(T.IntegerType())
    def again(i):
        import pandas as pd

        if not len(tops):
            return pd.Series(np.full(len(i), -1, np.int32))
        x = i.fillna(tops[0] - 1).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(tops, x), len(tops) - 1)
        return pd.Series(np.where(tops[at] == x, where[at], -1).astype(np.int32))

    own = F.struct(F.col("part"), F.lit(0).alias("end"))
    more = F.struct(F.col("again").alias("part"), F.lit(1).alias("end"))
    both = rows.withColumns({"part": part("doc_id"), "again": again("doc_id")})
    return both.select("doc_id", "text", F.explode(F.when(F.col("again") >= 0, F.array(own, more)).otherwise(F.array(own))).alias("x")).select("doc_id", "text", "x.part", "x.end")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, high long, low long"


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, high, low.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending doc_id, after the last the first. Ranges of ids are sorted within tasks, and each row meets
    the next one as rows stream by, across a range's end by a copy of the one row behind it: texts are shuffled once.
    high and low are the fingerprint's halves. Null texts count as empty; null ids come last; rows that repeat an id
    follow each other in the order of their texts; a lone row follows itself; an empty table gives none.
    """
    rows = ranged(texts(docs, id_col, text_col))
    rows = rows.repartition("part").sortWithinPartitions("part", "end", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        held = None  # part, doc_id, text, fingerprint of the row that waits for the next

        def joined(now):
            _, i, text, mark = held
            n = len(text)
            edited = text[: n - n // 2] + now[2][: n // 2]
            changed = mark if edited == text else fingerprint(edited, words)
            high, low = np.frombuffer(mark.tobytes(), ">i8")
            return (i, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark.tobytes().hex(), changed.tobytes().hex(), likeness(mark, changed), likeness(mark, now[3]), int(high), int(low))

        names = OUT.replace(",", "").split()[::2]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)
        for b in batches:
            out = []
            for i, text, part, end in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "end")), strict=True):
                if held and held[0] != part:  # a range whose rows have no id: its last row follows itself
                    out.append(joined(held))
                    held = None
                if end and not held:  # the row behind the range's end was there more than once
                    continue
                now = (part, i, text, fingerprint(text, words))
                if held:
                    out.append(joined(now))
                held = None if end else now
            yield table(out)
        if held:
            yield table([joined(held)])

    return rows.mapInArrow(run, OUT)


def tables(radius: int, kept: int = 2) -> list[tuple[int, int]]:
    """Masks (high, low) of the permuted tables: of radius + kept blocks, any `kept` agree if at most radius bits differ."""
    edges = np.linspace(0, BITS, radius + kept + 1).astype(int).tolist()
    blocks = [((1 << (BITS - a)) - 1) ^ ((1 << (BITS - b)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [sum(c) for c in combinations(blocks, kept)]
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in masks]


#: Bits that two texts of similarity 0.8 differ in: 19 on average (the angle of cosine 8/9), and two standard deviations.
RADIUS = 27
#: Radius whose tables still have keys of 20 bits or more, and the queries of a pass of the scan (16 bytes each).
TABLED, PASS = 10, 1_000_000


def within(marks: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, near_found for every row of queries (doc_id, high, low): the number of other rows of marks (high, low),
    which holds them too, with at most `radius` differing bits.

    Equal fingerprints are one entry with its number. Small radii are found by block tables, others by a scan: tables
    that guarantee them would have keys of a few bits.
    """
    entries = cut(marks.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies")))
    asked = cut(queries.select("high", "low").distinct())
    found = (tabled if radius <= TABLED else scanned)(entries, asked, radius)
    return queries.join(found, (F.col("high") == F.col("q_high")) & (F.col("low") == F.col("q_low"))).select("doc_id", (F.col("n") - 1).alias("near_found"))


def tabled(entries: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """q_high, q_low, n (copies found): every permuted table brings two blocks to the front as its key; entries and
    queries that agree there are compared on all bits."""
    masks = tables(radius)
    keyed = lambda d, *c: d.select(*c, "high", "low", F.explode(F.array(*(F.xxhash64(F.lit(t), F.col("high").bitwiseAND(F.lit(h)), F.col("low").bitwiseAND(F.lit(w))) for t, (h, w) in enumerate(masks)))).alias("key"))
    x = keyed(entries, "copies")
    y = keyed(asked).select(F.col("high").alias("q_high"), F.col("low").alias("q_low"), F.col("key").alias("q_key"))
    differ = F.bit_count(F.col("high").bitwiseXOR(F.col("q_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("q_low")))
    pairs = x.join(y, (F.col("key") == F.col("q_key")) & (differ <= radius)).select("q_high", "q_low", "high", "low", "copies").distinct()
    return pairs.groupBy("q_high", "q_low").agg(F.sum("copies").alias("n"))


def scanned(entries: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """q_high, q_low, n (copies found): every entry is compared with every query, PASS queries at a time at most.

    The queries of a pass go to all executors as two arrays; a task returns its count for each query with any.
    """
    passes, found = -(-asked.count() // PASS), None
    for k in range(max(1, passes)):
        part = asked.where(F.pmod(F.xxhash64("high", "low"), F.lit(max(1, passes))) == k).toArrow()
        held = asked.sparkSession.sparkContext.broadcast([part.column(c).to_numpy().view(U) for c in ("high", "low")])

        def run(batches, held=held):
            high, low = held.value
            n = np.zeros(len(high), np.int64)
            for b in batches:
                h, w, c = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64).view(kind) for x, kind in (("high", U), ("low", U), ("copies", np.int64)))
                for i in range(0, len(h), 64):
                    for j in range(0, len(high), 4096):
                        differ = np.bitwise_count(h[i : i + 64, None] ^ high[None, j : j + 4096])
                        differ += np.bitwise_count(w[i : i + 64, None] ^ low[None, j : j + 4096])
                        x, y = np.divmod(np.flatnonzero(differ.ravel() <= radius), differ.shape[1])
                        np.add.at(n, j + y, c[i + x])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), pa.array(n[at])], ["q_high", "q_low", "n"])

        one = entries.mapInArrow(run, "q_high long, q_low long, n long")
        found = one if found is None else found.union(one)
    return found.groupBy("q_high", "q_low").agg(F.sum("n").alias("n"))
