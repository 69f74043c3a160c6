"""Measures of a linkage with and without truth, estimates of overlap, and thresholds from a histogram."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linkage


def same_gid(l_gid: Column, r_gid: Column) -> Column:
    return F.coalesce(l_gid == r_gid, F.lit(False))


def same_first_part(l: Column, r: Column) -> Column:  # noqa: E741
    """Ids whose part before the first underscore agrees."""
    return F.split_part(l, F.lit("_"), F.lit(1)) == F.split_part(r, F.lit("_"), F.lit(1))


def same_middle_part(l: Column, r: Column) -> Column:  # noqa: E741
    """Ids whose second part between hyphens agrees."""
    return F.split_part(l, F.lit("-"), F.lit(2)) == F.split_part(r, F.lit("-"), F.lit(2))


def mapped(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """links with `hit`: whether the mapping (l, r) holds the pair."""
    return links.join(mapping.select("l", "r").distinct().withColumn("hit", F.lit(True)), ["l", "r"], "left").fillna(False, ["hit"])


def f_measure(recall: Column, precision: Column) -> Column:
    return F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))


def true_pairs(records: DataFrame) -> DataFrame:
    """truth, most: pairs to be found and pairs that may be compared; within a party only if it is not free of duplicates.

    Counted from group sizes; no pair is formed. Records without gid are true pairs of none.
    """
    def pairs(by: list[str], rows: DataFrame) -> DataFrame:
        n = rows.groupBy(*by, "party").agg(F.count(F.lit(1)).alias("n"), F.max("duplicate_free").alias("free"))
        own = F.when(F.col("free"), 0).otherwise(F.expr("n * (n - 1) div 2"))
        g = n.groupBy(*by) if by else n.groupBy()
        x = g.agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(own).alias("own"))
        return x.agg(F.sum(F.expr("(s * s - q) div 2") + F.col("own")).alias("v"))

    return pairs(["gid"], records.where("gid is not null")).select(F.coalesce("v", F.lit(0)).alias("truth")).crossJoin(pairs([], records).select(F.coalesce("v", F.lit(0)).alias("most")))


def evaluate(records: DataFrame, links: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of distinct links (l, r) of records (rid, gid, party, duplicate_free)."""
    g = records.select("rid", "gid")
    x = links.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).where("l != r").distinct()
    x = x.join(g.select(F.col("rid").alias("l"), F.col("gid").alias("lg")), "l").join(g.select(F.col("rid").alias("r"), F.col("gid").alias("rg")), "r")
    hit = same_gid(F.col("lg"), F.col("rg"))
    return scores(records, x.agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp")))


def scores(records: DataFrame, counts: DataFrame) -> DataFrame:
    """As evaluate, from one row of counts (tp, fp)."""
    x = counts.crossJoin(true_pairs(records))
    x = x.select("tp", "fp", (F.col("truth") - F.col("tp")).alias("fn"), (F.col("most") - F.col("truth") - F.col("fp")).alias("tn"))
    x = x.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})
    return x.withColumn("f1", f_measure(F.col("recall"), F.col("precision")))


def structure(links: DataFrame, source_all: int, target_all: int) -> DataFrame:
    """Estimates without truth: from the number of links and of records that have any.

    precision_one_to_one, precision_one_to_n, precision_probability, recall_n_to_m, recall_one_to_n, recall_one_to_one, harmony.
    """
    total = lambda v: F.sum("sim").over(Window.partitionBy(v))
    top = lambda v: F.max("sim").over(Window.partitionBy(v))
    x = links.withColumns({"sl": total("l"), "sr": total("r"), "strong": (F.col("sim") == top("l")) | (F.col("sim") == top("r"))})
    p = F.when(F.col("strong"), F.col("sim") * F.col("sim") / F.col("sl") / F.col("sr")).otherwise(0.0)
    both = linkage.max_both(links).agg(F.count(F.lit(1)).alias("both"))
    x = x.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("l").alias("s"), F.countDistinct("r").alias("t"), F.sum(p).alias("p")).crossJoin(both)
    s, t, n, least = F.col("s"), F.col("t"), F.col("links"), min(source_all, target_all)
    one = F.lit(1.0)
    return x.select(
        F.try_divide(F.least(s, t), n).alias("precision_one_to_one"),
        F.try_divide(s + t, 2 * n).alias("precision_one_to_n"),
        F.try_divide("p", n).alias("precision_probability"),
        F.least(one, n / least).alias("recall_n_to_m"),
        F.least(one, (s + t) / (source_all + target_all)).alias("recall_one_to_n"),
        F.least(one, (s + t) / (2 * least)).alias("recall_one_to_one"),
        (F.col("both") / least).alias("harmony"),
    )


def overlap_estimate(records: DataFrame, key: Column, left: str, right: str, size: int = 2**13) -> DataFrame:
    """estimate: correlation of the counting filters of two parties' keyed ids, scaled by their sizes; negative ones count as 0.

    Only `size` counts a party are kept, however many records there are.
    """
    at = F.pmod(F.conv(F.substring(F.sha2(key, 512), 1, 15), 16, 10).cast("bigint"), F.lit(size))
    x = records.where(F.col("party").isin(left, right)).select(at.alias("at"), "party")
    n = x.groupBy("at").agg(F.count_if(F.col("party") == left).alias("a"), F.count_if(F.col("party") == right).alias("b"))
    grid = records.sparkSession.range(size).select(F.col("id").alias("at"))
    c = grid.join(n, "at", "left").fillna(0, ["a", "b"]).agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("c"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return c.select(F.greatest(F.lit(0.0), F.coalesce(F.col("c") * F.sqrt(F.try_divide(high, low)) * low, F.lit(0.0))).alias("estimate"))


def counts(histogram: DataFrame, bins: int) -> np.ndarray:
    """The counts of a histogram (bin, n), empty bins too: at most `bins` rows reach the driver."""
    out = np.zeros(bins)
    for r in histogram.collect():
        out[r.bin] = r.n
    return out


def plateau(value: np.ndarray, best: float) -> tuple[int, int]:
    at = np.flatnonzero(value >= best)
    return int(at[0]), int(at[-1])


def otsu(n: np.ndarray) -> float:
    """The cut of the largest variance between the two sides; of equal cuts the middle; NaN if there is none."""
    bins = len(n)
    center = (np.arange(bins) + 0.5) / bins
    below, mass = np.cumsum(n)[:-1], np.cumsum(n * center)[:-1]
    above = n.sum() - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return math.nan
    spread = np.zeros(bins - 1)
    spread[ok] = below[ok] * above[ok] * (mass[ok] / below[ok] - ((n * center).sum() - mass[ok]) / above[ok]) ** 2
    first, last = plateau(spread, spread.max() * (1 - 1e-9))
    return (first + last + 2) / 2 / bins


def valley(n: np.ndarray, radius: int = 2, apart: float = 0.10, ratio: float = 0.5) -> float:
    """The middle of the floor between the two main peaks of a histogram, or NaN where no valley parts them.

    Counts are means over `radius` bins to each side. The main peak is the first highest bin. Its partner is the highest
    local maximum (the first of equal ones) at least a share `apart` of the bins away, beyond which the counts in between
    fall to `ratio` of the lower of the two. The running minimum outward from the main peak says, for every bin at once,
    how deep the way there falls.
    """
    bins, width = len(n), 2 * radius + 1
    sums = np.concatenate([[0.0], np.cumsum(n, dtype=float)])
    at = np.arange(bins)
    low, high = np.maximum(0, at - radius), np.minimum(bins, at + radius + 1)
    level = (sums[high] - sums[low]) / np.minimum(width, high - low)
    if not bins or not level.max() > 0:
        return math.nan
    top = int(level.argmax())
    floor = np.concatenate([np.minimum.accumulate(level[top::-1])[:0:-1], np.minimum.accumulate(level[top:])])
    rises, falls = np.diff(level, prepend=-np.inf) >= 0, np.diff(level, append=-np.inf) <= 0
    partner = rises & falls & (level > 0) & (np.abs(at - top) >= math.ceil(apart * bins)) & (floor <= ratio * np.minimum(level, level[top]))
    if not partner.any():
        return math.nan
    other = int(np.where(partner, level, -np.inf).argmax())
    between = np.arange(min(top, other), max(top, other) + 1)
    bottom = between[level[between] <= floor[other] + 1e-12]
    return float((bottom[0] + bottom[-1] + 1) / 2 / bins)


def best_threshold(matches: np.ndarray, others: np.ndarray, truth: int) -> tuple[float, float]:
    """The threshold (middle of equal ones) of the best F1 that the true and false counts allow, and that F1."""
    above = lambda n: np.append(np.cumsum(n[::-1])[::-1], 0.0)
    tp, fp = above(matches), above(others)
    whole = 2 * tp + fp + np.maximum(0.0, truth - tp)
    f1 = np.divide(2 * tp, whole, out=np.zeros_like(tp), where=whole > 0)
    first, last = plateau(f1, f1.max() - 1e-12)
    return (first + last) / 2 / len(matches), float(f1.max())


def sweep(links: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, links, l, r: links and linked ends at each threshold, in one pass over the links."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    x = links.withColumn("threshold", at).where(F.col("sim") >= F.col("threshold"))
    return x.groupBy("threshold").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("l").alias("l"), F.countDistinct("r").alias("r"))
