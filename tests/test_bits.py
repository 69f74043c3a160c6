import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.functions import bits, hardening, lsh
from linkspark.functions.similarity import words_of

M = 128


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(1)
    rows = [(i, sorted(r.sample(range(M), k))) for i, k in enumerate([0, 1, 40, 64, 128])] + [(5, [127]), (6, [0, 63, 64, 127])]
    return rows, spark.createDataFrame(rows, "rid int, p array<int>").select("rid", "p", words_of(F.col("p"), 2).alias("w")).cache()


def dense(p):
    b = np.zeros(M, dtype=int)
    b[p] = 1
    return b


def run(df, column):
    return {r.rid: r.x for r in df.select("rid", column.alias("x")).collect()}


def positions(df, column):
    """Positions of vectors that Python made, which no lambda may hold."""
    return {i: np.flatnonzero(hardening.unpacked(v)).tolist() for i, v in run(df, column).items()}


def test_formats(vectors):
    rows, df = vectors
    w = F.col("w")
    assert run(df, bits.positions(w, 2)) == dict(rows)
    assert run(df, bits.binary_string(w, 2)) == {i: "".join(map(str, dense(p))) for i, p in rows}
    assert run(df, bits.length(w, 2)) == {i: max(p, default=-1) + 1 for i, p in rows}
    plain = lambda p: base64.b64encode(np.packbits(dense(p).astype(np.uint8), bitorder="little").tobytes().rstrip(b"\0")).decode()
    assert run(df, bits.to_base64(w, 2)) == {i: plain(p) for i, p in rows}
    assert run(df, bits.positions(bits.from_base64(bits.to_base64(w, 2), 2), 2)) == dict(rows)


def test_operations(vectors):
    rows, df = vectors
    w, mask = F.col("w"), words_of(F.array(*map(F.lit, range(0, M, 3))), 2)
    three = dense(list(range(0, M, 3)))
    for f, g in ((bits.and_, lambda a: a & three), (bits.nand, lambda a: 1 - (a & three)), (bits.nor, lambda a: 1 - (a | three)), (bits.xor, lambda a: a ^ three), (bits.and_not, lambda a: a & (1 - three))):
        assert run(df, bits.positions(f(w, mask, 2), 2)) == {i: np.flatnonzero(g(dense(p))).tolist() for i, p in rows}
    for i, c in run(df, bits.pair_counts(w, mask, 2)).items():
        a = dense(rows[i][1])
        assert (c.c00, c.c01, c.c10, c.c11) == tuple(int(((a == x) & (three == y)).sum()) for x in (0, 1) for y in (0, 1))


def test_automata_and_shifts(vectors):
    rows, df = vectors
    w = F.col("w")
    prev, nxt = (lambda a: np.roll(a, 1)), (lambda a: np.roll(a, -1))
    assert run(df, bits.positions(hardening.rule90(w, 2), 2)) == {i: np.flatnonzero(prev(dense(p)) ^ nxt(dense(p))).tolist() for i, p in rows}
    assert run(df, bits.positions(hardening.rule30(w, 2), 2)) == {i: np.flatnonzero(prev(dense(p)) ^ (dense(p) | nxt(dense(p)))).tolist() for i, p in rows}
    assert run(df, bits.positions(bits.up(w, 2), 2)) == {i: [x + 1 for x in p if x < M - 1] for i, p in rows}


def test_hardening(vectors):
    rows, df = vectors
    w, rid = F.col("w"), F.col("rid")
    balanced = run(df, hardening.balanced(w, 2, 7))
    assert all(sum(bin(x & (1 << 64) - 1).count("1") for x in v) == M for v in balanced.values())
    for f in (lambda p: hardening.randomized_response(w, rid, p, 3), lambda p: hardening.flip(w, rid, p, 3), lambda p: hardening.noise(w, rid, True, p, 3)):
        assert positions(df, f(0.0)) == dict(rows)
        assert run(df.repartition(3), f(0.5)) == run(df, f(0.5))
    assert positions(df, hardening.flip(w, rid, 1.0, 3)) == {i: sorted(set(range(M)) - set(p)) for i, p in rows}
    assert run(df, hardening.window_xor(w, 1))[0] == [0, 0]
    assert positions(df, hardening.window_xor(w, 1))[5] == [126, 127]
    assert run(df, hardening.resampled(w, 2, 5))[4] == [0, 0]
    assert all(len(v) == 1 for v in run(df, hardening.rehashed(w, 2, 16, 8, 3, 64, 9)).values())
    assert run(df, hardening.two_step(F.array(F.col("p"), F.col("p")), M))[0] == []


def test_lsh(vectors):
    rows, df = vectors
    drawn = lsh.sampled_positions(4, 3, M, 11)
    want = {i: [",".join(str(j) for j, q in enumerate(g) if q in p) for g in drawn] for i, p in rows}
    assert run(df, lsh.hamming_keys(F.col("w"), drawn)) == want
    from linkspark.functions.hashing import shuffled

    first = lambda p, k, j: str(next(q for q in shuffled(M, 5 + j + 5 * k) if q in p))
    want = {i: [",".join(first(p, k, j) for j in range(2)) for k in range(3)] if p else [] for i, p in rows}
    assert run(df, lsh.jaccard_keys(F.col("w"), 2, 3, M, 5)) == want
    assert all(len(g) == 4 for g in lsh.restricted_positions(df, "w", 4, 3, M, 1, 0.2))
    with pytest.raises(ValueError):
        lsh.sampled_positions(65, 2, M, 1)
