import itertools
import math
import random

import numpy as np
import pytest

from linkspark.operators import clustering, matching, quality


def graphs():
    r = np.random.default_rng(3)
    for _ in range(60):
        s = np.round(r.random((r.integers(1, 6), r.integers(1, 6))), 2)
        yield np.where(r.random(s.shape) < 0.5, s, 0.0)


def choices(s):
    rows, columns = s.shape
    for k in range(min(rows, columns) + 1):
        for a in itertools.combinations(range(rows), k):
            for b in itertools.permutations(range(columns), k):
                if all(s[i, j] > 0 for i, j in zip(a, b, strict=True)):
                    yield list(zip(a, b, strict=True))


def test_matchings_against_all_choices():
    for s in graphs():
        weight = lambda c, s=s: sum(s[i, j] for i, j in c)
        every = list(choices(s))
        for name, f in matching.METHODS.items():
            got = f(s)
            assert got in every or sorted(got) in [sorted(c) for c in every], name
        assert math.isclose(weight(matching.assignment(s)), max(map(weight, every)), abs_tol=1e-9)
        assert len(matching.most_links(s)) == max(map(len, every))
        held = dict(matching.stable(s))
        owner = {j: i for i, j in held.items()}
        for i, j in zip(*np.nonzero(s), strict=True):
            happier_row = i not in held or s[i, j] > s[i, held[i]]
            happier_column = j not in owner or s[i, j] > s[owner[j], j]
            assert not (happier_row and happier_column)


@pytest.mark.parametrize("method", list(matching.METHODS))
def test_matching_of_a_frame(spark, method):
    rows = [("a1", "b1", 0.9), ("a1", "b2", 0.8), ("a2", "b1", 0.85), ("a3", "b3", 0.5), ("a3", "b3", 0.4)]
    got = matching.matching(spark.createDataFrame(rows, "l string, r string, sim double"), method).collect()
    assert len({x.l for x in got}) == len(got) == len({x.r for x in got})
    assert ("a3", "b3", 0.5) in [tuple(x) for x in got]
    if method == "maximum_weight":
        assert {(x.l, x.r) for x in got} == {("a1", "b2"), ("a2", "b1"), ("a3", "b3")}


def test_clip(spark):
    rows = [("a1", "b1", 0.9), ("a1", "b2", 0.8), ("a2", "b1", 0.85), ("a2", "b2", 0.2)]
    got = matching.clip(spark.createDataFrame(rows, "l string, r string, sim double")).collect()
    assert {(x.l, x.r, x.sim) for x in got} == {("a1", "b1", 0.9)}
    rows = [("a", "w", 0.81), ("a", "x", 0.80), ("c", "w", 0.49), ("c", "x", 0.61), ("d", "x", 0.68)]  # degrees of all links count
    got = matching.clip(spark.createDataFrame(rows, "l string, r string, sim double")).collect()
    assert {(x.l, x.r) for x in got} == {("a", "w"), ("c", "x")}
    rows = [(a, b, 0.5) for a in "ab" for b in "xy"]  # of equal links each vertex has one best
    assert {(x.l, x.r) for x in matching.clip(spark.createDataFrame(rows, "l string, r string, sim double")).collect()} == {("a", "x")}
    s = np.array([[0, 0.9, 0.8, 0], [0.9, 0, 0.7, 0], [0.8, 0.7, 0, 0.6], [0, 0, 0.6, 0]])
    assert clustering.clip(s, ["A", "B", "C", "A"]) == [0, 0, 0, 3]


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(12), r.choice("ABC")) for i in range(60)]
    free = {"A": True, "B": False, "C": False}
    records = spark.createDataFrame([(i, g, p, free[p]) for i, g, p in rows], "rid int, gid int, party string, duplicate_free boolean")
    allowed = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[2] != b[2] or not free[a[2]])}
    gid = {i: g for i, g, _ in rows}
    links = r.sample(sorted(allowed), 200)
    got = quality.evaluate(records, spark.createDataFrame(links + links[:9], "l int, r int")).first()
    tp = sum(gid[a] == gid[b] for a, b in links)
    truth = sum(gid[a] == gid[b] for a, b in allowed)
    assert (got.tp, got.fp, got.fn, got.tn) == (tp, 200 - tp, truth - tp, len(allowed) - truth - 200 + tp)
    assert math.isclose(got.precision, tp / 200) and math.isclose(got.recall, tp / truth)
    empty = quality.evaluate(records.where("false"), spark.createDataFrame([], "l int, r int")).first()
    assert (empty.tp, empty.fn, empty.f1) == (0, 0, 0.0)


def test_overlap_estimate(spark):
    from pyspark.sql import functions as F

    a = spark.range(0, 3000).select(F.col("id").cast("string").alias("k"), F.lit("A").alias("party"))
    b = spark.range(2000, 5000).select(F.col("id").cast("string").alias("k"), F.lit("B").alias("party"))
    got = quality.overlap_estimate(a.union(b), F.concat(F.lit("key"), "k"), "A", "B").first().estimate
    assert abs(got - 1000) < 150
    assert quality.overlap_estimate(a, F.col("k"), "A", "B").first().estimate == 0.0


def test_thresholds():
    n = np.zeros(20)
    n[[2, 3, 4]], n[[15, 16]] = 100, 60
    assert 0.25 <= quality.otsu(n) <= 0.75
    assert 0.25 <= quality.valley(n) <= 0.75
    assert math.isnan(quality.otsu(np.zeros(20))) and math.isnan(quality.valley(np.zeros(20)))
    match, other = np.where(n == 60, n, 0), np.where(n == 100, n, 0)
    t, f1 = quality.best_threshold(match, other, 120)
    assert f1 == 1.0 and math.isclose(t, (5 + 15) / 40)
