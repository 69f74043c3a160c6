"""The nearest found against a plain scan of all vectors, at production parameters and on awkward rows."""

import numpy as np
import pytest

from linkspark.llm import neighbours


def scan(ids, v, k=20, every=20):
    """(query, rank, id, score) of the true nearest: all scores in double precision, sorted."""
    out = {}
    for i in np.flatnonzero(ids % every == 0).tolist():
        s = (v[i].astype(float)[None, :] * v.astype(float)).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        first = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in first]
    return out


def found(df, **given):
    out = {}
    for r in neighbours.search(df, **given).orderBy("query_id", "rank").collect():
        at = out.setdefault(r["query_id"], [])
        at.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(at)
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) / len(x) for q, x in want.items()])


def table(spark, ids, v, kind="float"):
    return spark.createDataFrame([(int(i), x.tolist(), "clash") for i, x in zip(ids, v, strict=True)], f"vec_id long, embedding array<{kind}>, part string").repartition(3)


@pytest.mark.parametrize("n", [500, 4000])
def test_recall_on_random_directions(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 64)).astype("float32")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = scan(np.arange(n), v)
    got = found(table(spark, np.arange(n), v))
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    assert recall(got, want) >= 0.9 and all(scores.get((q, i), s) == s for q, x in got.items() for i, s in x) and all(len(x) == 20 for x in got.values())


def test_recall_and_savings_on_groups(spark):
    """With structure in the data few parts are asked, and recall holds."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 32)) * 4
    v = (centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 32))).astype("float32")
    router, share = neighbours.learn(v[:2000].astype(float), 16)
    assert router.w.shape[1] == 16 and router.probed(v[2000:].astype(float), share).mean() < 0.5
    assert recall(found(table(spark, np.arange(3000), v)), scan(np.arange(3000), v)) >= 0.9


def test_parts_and_router_at_every_size():
    r = np.random.default_rng(3)
    for n in (64, 500, 2000):
        router, share = neighbours.learn(r.normal(size=(n, 16)), neighbours.PARTS)
        assert router.w.shape[1] == 16 and np.abs(router.w).max() > 0 and 0 < share <= 2


def test_ties_repeats_and_scales(spark):
    """Equal vectors go by id; tiny scores beside large norms are ranked exactly; all parts asked, the result is exact."""
    r = np.random.default_rng(4)
    v = r.normal(size=(700, 8)).astype("float64")
    v[100:400] = v[100]
    v[400:] *= 1e3
    v[500] = [1e6, *[0.0] * 7]
    v[501:600, 0] = r.normal(size=99) * 1e-9
    ids = np.arange(700)
    ids[20] = 0  # an id twice
    got, want = found(table(spark, ids, v, "double"), share=2.0), scan(np.where(np.arange(700) == 20, 0, ids), v)
    for q in want:
        if q:
            assert got[q] == want[q], q


def test_hot_vector_over_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 150)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    v = np.random.default_rng(8).normal(size=(600, 16)).astype("float32")
    v[:250] = v[0]
    assert found(table(spark, np.arange(600), v), share=2.0) == scan(np.arange(600), v)


def test_rows_that_take_no_part(spark):
    v = np.random.default_rng(6).normal(size=(12, 4)).tolist()
    odd = [(None, v[0]), (100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [None, 1.0, 1.0, 1.0]), (180, [1.0]), (200, [float("inf"), 1.0, 1.0, 1.0]), (220, [])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    got = found(df)
    assert got == scan(np.arange(12), np.array(v)) and len(got[0]) == 11
    for few in (0, 1, 2):
        x = spark.createDataFrame([(i, y) for i, y in enumerate(v[:few])], "vec_id long, embedding array<double>")
        assert sum(map(len, found(x).values())) == (1 if few == 2 else 0)
