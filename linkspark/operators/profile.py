"""Profiles of a data set: counts, overlaps, availability, lengths, frequencies, patterns, and differences in clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits
from . import tiles

# Texts that stand for an invalid value.
INVALID = ("null", "NULL", "Null", "NaN")


def record_counts(records: DataFrame) -> DataFrame:
    """party (total for all), n."""
    return records.rollup("party").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("party", F.lit("total")).alias("party"), "n")


def overlaps(records: DataFrame) -> DataFrame:
    """l_party, r_party, n: pairs of records of one gid, by their parties."""
    x = records.select("gid", F.col("party").alias("l_party"), F.col("rid").alias("l"))
    y = records.select("gid", F.col("party").alias("r_party"), F.col("rid").alias("r"))
    pairs = x.join(y, "gid").where((F.col("l_party") < F.col("r_party")) | ((F.col("l_party") == F.col("r_party")) & (F.col("l") < F.col("r"))))
    return pairs.groupBy("l_party", "r_party").agg(F.count(F.lit(1)).alias("n"))


def cluster_sizes(records: DataFrame) -> DataFrame:
    s = records.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count("n").alias("clusters"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_samp("n").alias("deviation"))


def availability(rows: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, valid, invalid, empty, missing: shares of the rows."""
    x = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    bad, none = F.col("value").isin(*INVALID), F.col("value") == ""
    return x.groupBy("attribute").agg(share(F.col("value").isNotNull() & ~bad & ~none).alias("valid"), share(bad).alias("invalid"), share(none).alias("empty"), share(F.col("value").isNull()).alias("missing"))


def lengths(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "") & ~F.col(column).isin(*INVALID)).groupBy(F.char_length(column).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def frequencies(rows: DataFrame, column: str, least: int = 2) -> DataFrame:
    """value, n, share, cumulative: lower-cased values found at least `least` times, most frequent first."""
    x = rows.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    w = Window.orderBy(F.desc("n"), "value")
    x = x.where(F.col("n") >= least).crossJoin(F.broadcast(total))
    return x.select("value", "n", (F.col("n") / F.col("total")).alias("share"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("cumulative"))


def patterns(rows: DataFrame, column: str, named: dict[str, str]) -> DataFrame:
    """pattern, n: values that match each pattern as a whole, lower-cased."""
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.lower(column).rlike(f"^(?:{p})$").alias("hit")) for k, p in named.items())))
    return rows.select(one.alias("x")).groupBy("x.pattern").agg(F.count_if("x.hit").alias("n"))


def differences(records: DataFrame, columns: list[str]) -> DataFrame:
    """errors, pairs, distance: pairs of records of one gid by the number of columns that differ, and their edits.

    Distinct values are compared once, by tiles; from the pairs of all records of a gid those of one id are taken away.
    """
    x = records.where("gid is not null and rid is not null").select("gid", "rid", *(F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(columns)))
    values = [f"v{k}" for k in range(len(columns))]
    again = x.groupBy("gid", "rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gid", "rid")
    of = lambda d, sign, *by: d.select(F.to_json(F.struct(*by)).alias("block"), F.lit(sign).alias("sign"), *values)
    rows = of(x, 1, "gid").union(of(x.join(again, ["gid", "rid"]), -1, "gid", "rid"))
    rows = rows.groupBy("block", "sign", *values).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    equal = rows.select(F.lit(0).alias("errors"), F.expr("sign * (n * (n - 1) div 2)").alias("pairs"), F.lit(0).cast("bigint").alias("distance"))
    other = tiles.tiled(rows, lambda c, t: differing(c, values, t), "errors int, pairs long, distance long")
    return equal.union(other).groupBy("errors").agg(F.sum("pairs").alias("pairs"), F.sum("distance").alias("distance")).where("pairs > 0")


def differing(rows: dict, values: list[str], parts: list) -> list[tuple]:
    """errors, pairs, distance of the pairs of different rows of each tile, counted n times n times."""
    out = []
    for left, right in parts:
        varied = [v for v in values if len({rows[v][k] for side in (left, right) for k in side}) > 1]
        n, m = (np.array([rows["n"][k] for k in side]) for side in (left, right))
        longest = sum(max(len(rows[v][k] or "") for side in (left, right) for k in side) for v in varied)
        if int(n.sum()) * int(m.sum()) * max(1, longest) < 2**53:
            n, m = n.astype(float), m.astype(float)  # exact, and multiplied faster
        columns = [([rows[v][k] for k in left], [rows[v][k] for k in right]) for v in varied]
        sums = one_differs(*columns[0], n, m) if len(columns) == 1 else several_differ(columns, n, m)
        half, sign = 2 if left == right else 1, rows["sign"][left[0]]
        out += [(k, sign * (p // half), sign * (d // half)) for k, (p, d) in sums.items() if p]
    return out


def one_differs(xs: list, ys: list, n: np.ndarray, m: np.ndarray) -> dict:
    """pairs, distance by errors, of rows that only one column tells apart: its values are distinct on either side."""
    at = {x: k for k, x in enumerate(xs)}
    pairs = int(n.sum()) * int(m.sum()) - sum(int(m[k]) * int(n[at[y]]) for k, y in enumerate(ys) if y in at)
    return {1: (pairs, sum(int(m[k] * (d @ n)) for k, d in edits.distances([x or "" for x in xs], [y or "" for y in ys])))}


def several_differ(columns: list, n: np.ndarray, m: np.ndarray) -> dict:
    """pairs, distance by errors, of the rows whose columns are given as the values of either side."""
    sides, sums = [], {}
    for left, right in columns:
        xs, ys = list(dict.fromkeys(left)), list(dict.fromkeys(right))
        at, to, far = {x: k for k, x in enumerate(xs)}, {y: k for k, y in enumerate(ys)}, np.empty((len(ys), len(xs)), np.int32)
        for k, d in edits.distances([x or "" for x in xs], [y or "" for y in ys]):
            far[k] = d
        sides.append((far, np.array([at[x] for x in left]), np.array([to[y] for y in right]), np.array([at.get(y, -1) for y in ys])))
    for a in range(0, len(m), 256):
        wrong, edit = 0, 0
        for far, x, y, same in sides:
            y = y[a : a + 256]
            wrong = wrong + (same[y][:, None] != x[None, :]).astype(np.int8)
            edit = edit + far[y][:, x]
        for k in range(1, len(sides) + 1):
            hit = wrong == k
            pairs, distance = (int(m[a : a + 256] @ (w @ n)) for w in (hit, edit * hit))
            old = sums.get(k, (0, 0))
            sums[k] = old[0] + pairs, old[1] + distance
    return sums
