"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

#: Vectors that the partitions and the classifier are fitted on, at most; neighbours of each in the graph.
SAMPLE, GRAPH = 8_192, 10
#: Parts at least (of tables with four times as many vectors) and at most, and vectors of one between the two.
PARTS, MOST, EACH = 16, 128, 2_000
#: Queries that are ranked together, and candidates that one task streams by them.
QUERIES, SLICE = 512, 131_072
#: Recall that the share of probability to probe is chosen for, on the sample; pairs of block and part broadcast at most.
AIM, FEW = 0.95, 100_000


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors of the most common length, of finite components, not all zero."""
    kind = rows.schema[vector_col].dataType
    wide = not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))  # floats travel as they are
    v = F.col(vector_col).cast("array<double>" if wide else "array<float>")
    x = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = x.where(~F.exists("v", bad) & F.exists("v", lambda c: c != 0))
    sizes = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return x.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector by inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of the neighbour graph of at most slack times the mean size, with few edges between them.

    They grow from far-apart seeds; then vertices move to the part of most of their neighbours while it has room.
    """
    n, room = len(x), math.ceil(slack * len(x) / parts)
    r = np.random.default_rng(5)
    seeds = [int(r.integers(n))]
    closest = x @ x[seeds[0]]
    for _ in range(parts - 1):
        seeds.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[seeds[-1]])
    likes = x @ x[seeds].T
    part, size = np.full(n, -1), np.zeros(parts, np.int64)

    def place(i, order):
        for p in order:
            if size[p] < room:
                part[i] = p
                size[p] += 1
                return

    for i in np.argsort(-np.partition(likes, -1, axis=1)[:, -1], kind="stable"):
        place(i, np.argsort(-likes[i], kind="stable"))
    back = [[] for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[i].append(j)
            back[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in r.permutation(n).tolist():
            votes = np.bincount(part[back[i]], minlength=parts)
            size[part[i]] -= 1
            best = int(np.argmax(np.where(size < room, votes, -1)))
            best = best if votes[best] > votes[part[i]] else part[i]
            moved += best != part[i]
            part[i] = best
            size[best] += 1
        if moved < n // 200:
            break
    return part


class Router:
    """Multinomial logistic regression from a vector to its part, by mini-batch gradient steps."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, epochs: int = 40, rate: float = 0.3):
        parts = soft.shape[1]
        self.scale = 1 / max(1e-12, float(np.sqrt((x * x).sum(axis=1).mean())))
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        mw, mb, r = np.zeros_like(self.w), np.zeros_like(self.b), np.random.default_rng(11)
        for epoch in range(epochs):
            step = rate * 10 * (1 - epoch / epochs)
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // 256)):
                e = self.probabilities(x[rows]) - soft[rows]
                mw = 0.9 * mw + self.scale * x[rows].T @ e / len(rows)
                mb = 0.9 * mb + e.mean(axis=0)
                self.w -= step * mw
                self.b -= step * mb

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (self.scale * x) @ self.w + self.b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :count]

    def probed(self, x: np.ndarray, share: float) -> np.ndarray:
        """For each vector and part, whether it is asked: the most probable parts until their probabilities reach `share`."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, axis=1)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, np.cumsum(sorted_p, axis=1) - sorted_p < share, axis=1)
        return out


def learn(x: np.ndarray, parts: int, aim: float = AIM, k: int = 20) -> tuple[Router, float]:
    """The router, and the share of probability that a query must probe so that `aim` of the sample's true neighbours lie there."""
    parts = max(1, min(parts, len(x) // 4))
    if parts < 2:
        return Router(x[:1], np.ones((1, 1)), epochs=0), 1.0
    near = graph(x, min(GRAPH, len(x) - 1))
    part = balanced(x, near, parts)
    soft = np.zeros((len(x), parts))
    soft[np.arange(len(x)), part] = 1
    for j in range(near.shape[1]):  # a vector's neighbours say which parts it is near
        np.add.at(soft, (np.arange(len(x)), part[near[:, j]]), 1)
    router = Router(x, soft / soft.sum(axis=1, keepdims=True))
    home = router.ranked(x, 1)[:, 0]
    asked = np.random.default_rng(3).permutation(len(x))[:1000]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    true = home[np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k]]
    for share in np.linspace(0.05, 1.0, 96).tolist():
        if np.take_along_axis(router.probed(x[asked], share), true, axis=1).mean() >= aim:
            return router, share
    return router, 2.0


class Nearest:
    """The k best candidates found so far of each query of a block, by exact scores, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.norms = np.sqrt((v * v).sum(axis=1))
        self.row, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def see(self, rows: np.ndarray, cid: np.ndarray, c: np.ndarray) -> None:
        """Candidates for the queries in rows. A fast product finds who can be among the best so far, with room for its
        rounding; those scores are taken again in one fixed order of summation."""
        reach = 8 * c.shape[1] * np.finfo(float).eps * float(np.sqrt((c * c).sum(axis=1).max()))
        for at in range(0, len(rows), 64):
            q = rows[at : at + 64]
            s = self.v[q] @ c.T
            s[self.ids[q][:, None] == cid[None, :]] = -np.inf
            least = np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else np.full(len(q), -np.inf)
            i, j = np.nonzero((s >= (np.maximum(least, self.least[q]) - reach * self.norms[q])[:, None]) & (s > -np.inf))
            if len(i):
                self.add(q[i], cid[j], (self.v[q[i]] * c[j]).sum(axis=1))

    def add(self, row, found, score) -> None:
        touched = np.zeros(len(self.ids), bool)
        touched[row] = True
        old = touched[self.row]
        row, found, score = (np.concatenate([x[old], y]) for x, y in ((self.row, row), (self.found, found), (self.score, score)))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        nth = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
        full = nth == self.k - 1
        self.least[row[full]] = score[full]
        keep = nth < self.k
        self.row, self.found, self.score = (np.concatenate([x[~old], y[keep]]) for x, y in ((self.row, row), (self.found, found), (self.score, score)))

    def table(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.found), pa.array(self.score)], ["query_id", "vec_id", "score"])


def search(rows: DataFrame, k: int = 20, every: int = 20, parts: int | None = None, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`.

    At most SAMPLE vectors, picked by a hash of their id, are fitted: their graph of nearest neighbours is cut into
    balanced parts, and a linear classifier learns the parts of each vector and its neighbours. Every row is indexed
    under its most probable part. Every query asks its most probable parts until they hold `share` of the probability
    (if not given, the least that finds AIM of the sample's neighbours).

    Queries of like parts form blocks of about QUERIES. A block's task streams the candidates of all parts that any of
    its queries asks, at most about SLICE of them, each query seeing its own parts only; the k-th best score found so
    far bounds what can still count, and only the k best of a block and slice go on. So no task holds a part, and what
    goes on grows with the queries. Null ids, vectors that are null, zero, hold a null or non-finite component or have
    another length than most take no part; repeated ids are separate candidates and queries of their own; fewer than k
    candidates give fewer rows.
    """
    spark = rows.sparkSession
    x = cut(valid(rows, id_col, vector_col))
    n = x.count()
    at_most = max(1, min(1_000_000, SAMPLE * 1_000_000 // max(1, n)))
    sample = x.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < at_most).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        sample = x.limit(1).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    m = matrix(sample["v"]).astype(float)
    router, found_share = learn(m, parts or max(PARTS, min(MOST, n // EACH)), k=k)
    share = share or found_share
    kind = x.schema["v"].dataType.simpleString()

    def home(batches):
        for b in batches:
            part = router.ranked(matrix(b.column("v")).astype(float), 1)[:, 0].astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    def route(batches):
        for b in batches:
            v = matrix(b.column("v")).astype(float) if b.num_rows else None
            asked = [np.flatnonzero(p).tolist() for p in router.probed(v, share)] if b.num_rows else []
            first = router.ranked(v, 1)[:, 0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(first, pa.int32()), pa.array(asked, pa.list_(pa.int32()))], ["vec_id", "v", "home", "asked"])

    index = cut(x.mapInArrow(home, f"vec_id long, v {kind}, part int"))
    queries = cut(x.where(F.col("vec_id") % every == 0).mapInArrow(route, f"vec_id long, v {kind}, home int, asked array<int>"))
    counts = sorted((r["home"], r["n"]) for r in queries.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    homes = F.broadcast(spark.createDataFrame([(h, c, a) for (h, c), a in zip(counts, before, strict=False)] or [(-1, 1, 0)], "home int, n long, before long"))
    block = F.floor((F.col("before") + F.pmod(F.xxhash64(F.lit(9), "vec_id"), "n")) / QUERIES).cast("long").alias("block")
    queries = queries.join(homes, "home").select(block, "vec_id", "v", "asked")
    pairs = cut(queries.select("block", F.explode("asked").alias("part")).distinct())
    pairs = F.broadcast(pairs) if pairs.count() <= FEW else pairs
    slices = -(-n // SLICE)
    c = index.join(pairs, "part").select("block", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(slices)).cast("int").alias("slice"), "part", "vec_id", "v", F.lit(None).cast("array<int>").alias("asked"))
    q = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(-1).alias("part"), "vec_id", "v", "asked")
    wide = router.w.shape[1]

    def rank(batches):
        now, asks, held = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "slice", "part")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                one, (block, piece, part) = b.slice(i, j - i), keys[i].tolist()
                ids, v = one.column("vec_id").to_numpy(), matrix(one.column("v")).astype(float)
                if part < 0:
                    mine = np.zeros((len(ids), wide), bool)
                    lists = one.column("asked")
                    mine[np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                    if now == (block, piece):  # the block's queries go on in another batch
                        ids, v, mine = np.concatenate([held.ids, ids]), np.concatenate([held.v, v]), np.concatenate([asks, mine])
                    elif held is not None:
                        yield held.table()
                    now, asks, held = (block, piece), mine, Nearest(ids, v, k)
                elif now == (block, piece):
                    rows = np.flatnonzero(asks[:, part])
                    for at in range(0, len(ids), 2048):
                        held.see(rows, ids[at : at + 2048], v[at : at + 2048])
        if held is not None:
            yield held.table()

    dealt = c.union(q).repartition("block", "slice").sortWithinPartitions("block", "slice", "part")
    found = dealt.mapInArrow(rank, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
