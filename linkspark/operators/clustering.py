"""Clusterings of the components of a similarity graph (l, r, sim), each component in one grouped call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import connected

Edges = list[tuple[float, int, int]]


def ordered(s: np.ndarray, least: float = 0.0) -> Edges:
    """Edges of at least `least`, best first, ties to smaller ends."""
    n = len(s)
    return sorted(((-float(s[i, j]), i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] > 0 and s[i, j] >= least))


def center(s: np.ndarray, least: float = 0.0) -> list[int]:
    """Of two free vertices the first becomes a center and the other its leaf; a center takes free ones; no chains."""
    label, centers = [-1] * len(s), set()
    for _, i, j in ordered(s, least):
        if label[i] < 0 and label[j] < 0:
            label[i] = label[j] = i
            centers.add(i)
        elif i in centers and label[j] < 0:
            label[j] = i
        elif j in centers and label[i] < 0:
            label[i] = j
    return [i if x < 0 else x for i, x in enumerate(label)]


def merged(edges: Edges, parties: list) -> list[int]:
    """Clusters merge along the edges in order, unless that would put two records of a party together."""
    label = list(range(len(parties)))
    held = [{p} for p in parties]
    for _, i, j in edges:
        a, b = label[i], label[j]
        if a != b and not held[a] & held[b]:
            a, b = min(a, b), max(a, b)
            held[a] |= held[b]
            label = [a if x == b else x for x in label]
    return label


def source_consistent(s: np.ndarray, parties: list, least: float = 0.0) -> list[int]:
    return merged(ordered(s, least), parties)


def clip(s: np.ndarray, parties: list, least: float = 0.0) -> list[int]:
    """As source_consistent, without links that are best for neither end, by priority.

    Half the similarity, a tenth of the smaller degree, and 0.4 for a link best for both ends, 0.2 for one end.
    """
    top, degree = s.max(axis=1), (s > 0).sum(axis=1)
    edges = []
    for v, i, j in ordered(s, least):
        best = (s[i, j] == top[i]) + (s[i, j] == top[j])
        if best:
            edges.append((0.5 * v - 0.1 * int(min(degree[i], degree[j])) - 0.2 * int(best), i, j))
    return merged(sorted(edges), parties)


def markov(s: np.ndarray, inflation: float = 2.0, most: int = 100, close: float = 1e-6, prune: float = 1e-4) -> list[int]:
    """Flow with self loops is squared and inflated until it rests; a vertex goes to its strongest attractor."""
    n = len(s)
    if n <= 2:
        return [0] * n
    m = np.where(np.eye(n, dtype=bool), 1.0, s)
    m = m / m.sum(axis=0)
    for _ in range(most):
        x = (m @ m) ** inflation
        x /= x.sum(axis=0)
        x[x < prune] = 0
        x /= x.sum(axis=0)
        done = np.abs(x - m).max() < close
        m = x
        if done:
            break
    return m.argmax(axis=0).tolist()


METHODS = {"center": lambda s, _: center(s), "markov": lambda s, _: markov(s), "source_consistent": source_consistent, "clip": clip}


def clusters(records: DataFrame, links: DataFrame, method: str = "center", least: float = 0.0) -> DataFrame:
    """rid, cluster_id (the smallest rid) of every record (rid, party), by a method of METHODS.

    A component is one group and one dense matrix: links must have been classified, so that components stay small.
    """
    parts = connected(links)
    edges = links.where(F.col("sim") >= least).join(parts.withColumnRenamed("node", "l"), "l").select("component", "l", "r", "sim")
    kind = records.schema["rid"].dataType.simpleString()
    party = records.select(F.col("rid").alias("node"), "party")
    nodes = parts.join(party, "node").select("component", F.col("node").alias("l"), F.lit(None).cast(kind).alias("r"), F.lit(None).cast("double").alias("sim"), "party")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.party.notna()].sort_values("l")
        ids = own["l"].tolist()
        at = {x: i for i, x in enumerate(ids)}
        s = np.zeros((len(ids), len(ids)))
        e = pdf[pdf.party.isna()]
        for a, b, v in zip(e["l"], e["r"], e["sim"], strict=True):
            s[at[a], at[b]] = s[at[b], at[a]] = max(v, s[at[a], at[b]])
        label = METHODS[method](s, own.party.tolist())
        first: dict = {}
        for i, x in enumerate(label):
            first.setdefault(x, ids[i])
        return pd.DataFrame({"rid": ids, "cluster_id": [first[x] for x in label]})

    found = edges.withColumn("party", F.lit(None).cast("string")).unionByName(nodes).groupBy("component").applyInPandas(run, f"rid {kind}, cluster_id {kind}")
    return records.select("rid").join(found, "rid", "left").select("rid", F.coalesce("cluster_id", "rid").alias("cluster_id"))


def pass_probability(s: float, rows: int, bands: int) -> float:
    """Chance that a pair of similarity s shares a band."""
    return 1 - (1 - s**rows) ** bands
