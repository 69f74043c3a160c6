"""Best-fit packing: a configuration linear program over the length histogram, rounded and laid out."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, freeing, texts
from .tokenizing import WordBpe, load

#: Rows of one length that are numbered together, and the most such groups of one length.
GROUP, GROUPS = 256, 20_000
SEGMENTS = "length long, first long, until long, sequence long, per long, place long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and end_id, cut after every `capacity` ids."""

    def run(batches):
        t, end = load(WordBpe, tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(freeing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most value of any number of items of total length up to c; item[c]: index of one of them, -1 for none."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], item[c] = best[c - 1], -2  # -2: leave one place free
        if k := upto[c]:
            x = best[c - lengths[:k]] + values[:k]
            j = int(x.argmax())
            if x[j] > best[c]:
                best[c], item[c] = x[j], j
    return best, item


def follow(item: np.ndarray, lengths: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0 and item[c] != -1:
        if item[c] == -2:
            c -= 1
        else:
            out.append(int(item[c]))
            c -= int(lengths[item[c]])
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int, rate: float = 2.0) -> dict[tuple, float]:
    """Patterns and multiplicities of the covering program min sum x_p, sum_p a_ip x_p >= b_i, by multiplicative weights.

    A length's weight is its value in the pricing knapsack; it falls with the share of its demand that is covered. One
    dynamic program prices every step; of it, the best pattern that holds each of the least covered lengths is taken.
    The result is scaled so that no length is covered more than it is demanded: a later rounding down stays feasible.
    """
    covered, x = np.zeros(len(lengths)), Counter()
    for _ in range(steps):
        share = covered / demand
        weights = lengths * np.exp(-rate * (share - share.min()).clip(max=20))
        best, item = knapsack(lengths, weights, capacity)
        good = [i for i in np.argsort(share, kind="stable")[:256] if weights[i] + best[capacity - lengths[i]] >= 0.98 * best[capacity]]
        for i in good or [int(share.argmin())]:
            p = Counter([int(i), *follow(item, lengths, capacity - int(lengths[i]))])
            most = min(demand[j] / n for j, n in p.items())
            x[tuple(sorted(p.items()))] += 0.25 * most
            for j, n in p.items():
                covered[j] += 0.25 * most * n
    most = max(1.0, float((covered / demand).max()))
    return {p: v / most for p, v in x.items()}


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, of what rounding left over; equal sequences are handled as one."""
    open_: dict[int, list] = {}  # free places -> groups of [count, pattern]
    free: list[int] = []

    def put(count, room, pattern):
        if room not in open_:
            open_[room] = []
            insort(free, room)
        open_[room].append([count, pattern])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                per = min(n, capacity // length)
                count = n // per
                put(count, capacity - per * length, {length: per})
                n -= count * per
                continue
            room = free[at]
            group = open_[room][-1]
            take = min(n, group[0])
            group[0] -= take
            n -= take
            pattern = group[1] | {length: group[1].get(length, 0) + 1}
            if not group[0]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    free.pop(at)
            put(take, room - length, pattern)
    return [(c, p) for groups in open_.values() for c, p in groups]


def solve(histogram: dict[int, int], capacity: int, rounds: int = 8, steps: int = 24) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces in each}) that hold the histogram exactly.

    Each round solves the program for what is left and keeps the whole part of each pattern's multiplicity.
    """
    out, left = [], {k: v for k, v in histogram.items() if v}
    if full := left.pop(capacity, 0):
        out.append((full, {capacity: 1}))
    for _ in range(rounds):
        if sum(left.values()) < 64:
            break
        lengths = np.array(sorted(left))
        demand = np.array([left[k] for k in lengths.tolist()], float)
        kept = 0
        for p, v in sorted(fractional(lengths, demand, capacity, steps).items(), key=lambda y: -y[1]):
            if n := int(v + 1e-9):
                pattern = {int(lengths[j]): a for j, a in p}
                out.append((n, pattern))
                kept += n
                for k, a in pattern.items():
                    left[k] -= n * a
        left = {k: v for k, v in left.items() if v}
        if not kept:
            break
    # what is left has fewer of each length than patterns: fill one sequence at a time with the knapsack's patterns
    lengths = np.array(sorted(left))
    while len(lengths) and sum(left.values()) >= 64:
        best, item = knapsack(lengths, lengths.astype(float) ** 1.02, capacity)
        before = sum(left.values())
        for k in sorted(left, reverse=True):
            if left.get(k, 0):
                p = Counter([k, *(int(lengths[j]) for j in follow(item, lengths, capacity - k))])
                n = min(left.get(y, 0) // a for y, a in p.items())
                if n and sum(y * a for y, a in p.items()) >= capacity - 1:
                    out.append((n, dict(p)))
                    for y, a in p.items():
                        left[y] -= n * a
                        if not left[y]:
                            del left[y]
        if before - sum(left.values()) < 0.01 * before:
            break
        lengths = np.array(sorted(left))
    # sequences with room left are opened again, so that what is left can share them
    pool, full = Counter(left), []
    for n, p in out:
        if sum(k * a for k, a in p.items()) >= capacity - 1:
            full.append((n, p))
        else:
            pool.update({k: n * a for k, a in p.items()})
    return full + best_fit(dict(pool), capacity)


def segments(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of the pieces of one length, by their number: (length, first, until, first sequence, pieces in each, place)."""
    out, at, sequence = [], Counter(), 0
    for count, pattern in patterns:
        place = 0
        for length in sorted(pattern, reverse=True):
            per = pattern[length]
            out.append((length, at[length], at[length] + count * per, sequence, per, place))
            at[length] += count * per
            place += per * length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document at its place.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver, where the program is solved. Pieces of
    one length are numbered within groups of about GROUP rows by a hash, so a length that most rows share is spread over
    many tasks; the groups' counts are summed before. A piece's number picks its segment of the solution; the segments
    number at most a few for each length and pattern, whatever the input. Null texts are empty and have end_id alone;
    repeated rows are packed as often as they come; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = segments(solve(histogram, capacity))
    split = spark.createDataFrame([(k, min(GROUPS, -(-n // GROUP))) for k, n in histogram.items()], "length long, groups long")
    rows = rows.join(F.broadcast(split), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups")).drop("groups")
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    rows = rows.withColumn("number", number).join(counts, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before") - 1)
    s = spark.createDataFrame(plan, SEGMENTS).withColumnRenamed("length", "of")
    s = F.broadcast(s) if len(plan) <= 500_000 else s
    rows = rows.join(s, (F.col("length") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("until")))
    nth = F.col("number") - F.col("first")
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
