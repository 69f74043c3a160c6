"""One-to-one restrictions of links (l, r, sim) between two sides, each contested component in one grouped call.

Ids of the two sides must differ. A component must fit one task: links are classified before, which keeps them small;
greedy_matching and max_both of `linkage` need no such bound.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linkage

Chosen = list[tuple[int, int]]


def assignment(weight: np.ndarray) -> Chosen:
    """Pairs (row, column) of the largest total weight, by shortest augmenting paths with potentials.

    Weights of zero or less are no pairs.
    """
    if weight.size == 0:
        return []
    flip = weight.shape[0] > weight.shape[1]
    w = np.maximum(weight.T if flip else weight, 0.0)
    cost = w.max() - w
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        distance, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, column = new, -1
        while True:
            through = cost[row] - row_price[row] - column_price + (distance[column] if column >= 0 else 0.0)
            better = ~done & (through < distance - 1e-15)
            distance[better], before[better] = through[better], column
            column = int(np.where(done, np.inf, distance).argmin())
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        end = distance[column]
        settled = done & (distance < end)
        row_price[new] += end
        row_price[owner[settled]] += end - distance[settled]
        column_price[settled] -= end - distance[settled]
        while column >= 0:
            previous = before[column]
            owner[column] = new if previous < 0 else owner[previous]
            column = previous
    pairs = [(int(r), int(c)) for c, r in enumerate(owner) if r >= 0 and w[r, c] > 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def stable(s: np.ndarray) -> Chosen:
    """Rows propose from their best link down; a column keeps its best proposer, ties to the earlier row."""
    wishes = [[j for j in np.argsort(-row, kind="stable").tolist() if row[j] > 0] for row in s]
    at, held, free = [0] * len(s), {}, list(range(len(s)))[::-1]
    while free:
        i = free.pop()
        if at[i] == len(wishes[i]):
            continue
        j = wishes[i][at[i]]
        at[i] += 1
        old = held.get(j)
        if old is None or (s[i, j], -i) > (s[old, j], -old):
            held[j] = i
            i = old
        if i is not None:
            free.append(i)
    return sorted((i, j) for j, i in held.items())


def most_links(s: np.ndarray) -> Chosen:
    """As many links as possible, by layers of shortest augmenting paths."""
    near = [np.flatnonzero(row > 0).tolist() for row in s]
    mate_of_row, mate_of_column = [-1] * s.shape[0], [-1] * s.shape[1]
    while True:
        layer = {i: 0 for i, j in enumerate(mate_of_row) if j < 0}
        queue, found = list(layer), False
        for i in queue:
            for j in near[i]:
                k = mate_of_column[j]
                found |= k < 0
                if k >= 0 and k not in layer:
                    layer[k] = layer[i] + 1
                    queue.append(k)
        if not found:
            return sorted((i, j) for i, j in enumerate(mate_of_row) if j >= 0)
        for root in [i for i, j in enumerate(mate_of_row) if j < 0]:
            path = [(root, iter(near[root]), -1)]
            while path:
                i, rest, _ = path[-1]
                j = next(rest, None)
                if j is None:
                    layer.pop(i, None)
                    path.pop()
                    continue
                k = mate_of_column[j]
                path[-1] = (i, rest, j)
                if k < 0:
                    for a, _, b in path:
                        mate_of_row[a], mate_of_column[b] = b, a
                    break
                if layer.get(k) == layer.get(i, -2) + 1 and all(k != a for a, _, _ in path):
                    path.append((k, iter(near[k]), -1))


def few_rivals(s: np.ndarray) -> Chosen:
    """Links taken while both ends are free, those whose ends have fewest links first."""
    has = s > 0
    rows, columns = has.sum(axis=1), has.sum(axis=0)
    used_rows, used_columns, out = set(), set(), []
    for _, i, j in sorted((int(rows[i] + columns[j]), i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(has)), strict=True)):
        if i not in used_rows and j not in used_columns:
            used_rows.add(i)
            used_columns.add(j)
            out.append((i, j))
    return sorted(out)


METHODS: dict[str, Callable[[np.ndarray], Chosen]] = {"gale_shapley": stable, "maximum_weight": assignment, "maximum_cardinality": most_links, "greedy_cardinality": few_rivals}


def matching(links: DataFrame, method: str) -> DataFrame:
    """l, r, sim: a one-to-one subset of the links by a method of METHODS. Of repeated links the best counts."""
    f = METHODS[method]
    best = links.groupBy("l", "r").agg(F.max("sim").alias("sim"))
    parts = linkage.connected(best)
    x = best.join(parts.withColumnRenamed("node", "l"), "l").select("component", "l", "r", "sim")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(pdf["l"].unique()), sorted(pdf["r"].unique())
        a, b = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
        s = np.zeros((len(left), len(right)))
        s[pdf["l"].map(a), pdf["r"].map(b)] = pdf["sim"]
        return pd.DataFrame([(left[i], right[j], float(s[i, j])) for i, j in f(s)], columns=["l", "r", "sim"])

    kinds = [links.schema[c].dataType.simpleString() for c in ("l", "r")]
    return x.groupBy("component").applyInPandas(run, f"l {kinds[0]}, r {kinds[1]}, sim double")


def clip(links: DataFrame) -> DataFrame:
    """l, r, sim: greedy by half the similarity, a tenth of the least degree, and 0.4 for a link that is the best one of
    both its ends, 0.2 for one end's; links that are no end's best go.

    Degrees count all links. Every vertex has one best link, of equal ones that to the smaller other end.
    """
    degree = lambda v: F.count(F.lit(1)).over(Window.partitionBy(v))
    first = lambda v, other: F.row_number().over(Window.partitionBy(v).orderBy(F.desc("sim"), other)) == 1
    x = links.withColumns({"dl": degree("l"), "dr": degree("r"), "bl": first("l", "r"), "br": first("r", "l")}).where("bl or br")
    strength = F.when(F.col("bl") & F.col("br"), 1.0).otherwise(0.5)
    x = x.select("l", "r", F.col("sim").alias("own"), (0.5 * F.col("sim") + 0.1 * F.least("dl", "dr") + 0.4 * strength).alias("sim")).checkpoint()
    return linkage.greedy_matching(x.select("l", "r", "sim")).select("l", "r").join(x.select("l", "r", F.col("own").alias("sim")), ["l", "r"])
