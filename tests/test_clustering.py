"""Clustering engines on small matrices, and the grouped form on a table."""

import numpy as np
import pytest

from linkspark.operators import clustering


def matrix(n, edges):
    s = np.zeros((n, n))
    for i, j, v in edges:
        s[i, j] = s[j, i] = v
    return s


def test_center():
    assert clustering.center(matrix(4, [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)])) == [0, 0, 0, 0]
    assert clustering.center(matrix(3, [(0, 1, 0.9), (1, 2, 0.9)])) == [0, 0, 2]
    assert clustering.center(matrix(2, [(0, 1, 0.3)]), 0.5) == [0, 1]
    assert clustering.center(matrix(3, [(0, 2, 0.9), (1, 2, 0.9)])) == [0, 1, 0]


def test_source_consistent():
    s = matrix(3, [(0, 1, 0.95), (1, 2, 0.9)])
    assert clustering.source_consistent(s, [0, 1, 0]) == [0, 0, 2]
    assert clustering.source_consistent(matrix(2, [(0, 1, 0.9)]), [0, 0]) == [0, 1]
    assert [(i, j) for _, i, j in clustering.ordered(matrix(3, [(0, 2, 0.9), (0, 1, 0.7), (1, 2, 0.7)]))] == [(0, 2), (0, 1), (1, 2)]


def test_markov():
    s = np.full((6, 6), 0.05)
    s[:3, :3] = s[3:, 3:] = 0.9
    got = clustering.markov(s)
    assert len(set(got)) == 2 and len(set(got[:3])) == 1 and len(set(got[3:])) == 1
    assert clustering.markov(np.zeros((1, 1))) == [0] and clustering.markov(np.zeros((2, 2))) == [0, 0]


def test_pass_probability():
    assert [round(clustering.pass_probability(s, 6, 20), 4) for s in (0.4, 0.6, 0.8)] == pytest.approx([0.0788, 0.6154, 0.9977], abs=1e-4)


def test_clusters_of_a_table(spark):
    records = spark.createDataFrame([("a1", "A"), ("b1", "B"), ("a2", "A"), ("z", "B")], "rid string, party string")
    links = spark.createDataFrame([("a1", "b1", 0.95), ("a2", "b1", 0.9)], "l string, r string, sim double")
    assert {r["rid"]: r["cluster_id"] for r in clustering.clusters(records, links, "source_consistent").collect()} == {"a1": "a1", "b1": "a1", "a2": "a2", "z": "z"}
