"""Runs segmented together against one at a time, and the bound of the memo."""

import math
import zlib

import numpy as np
import pytest

from linkspark.llm import lattice
from linkspark.llm.common import Generations

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_runs_segmented_together_are_as_one_by_one():
    r = np.random.default_rng(1)
    words = {"▁" * int(r.integers(0, 2)) + "".join(r.choice(list("abcdeéhinorst日ﬀ"), int(n))) for n in r.integers(1, 28, 3000)} | {"aaaa", "▁aaaaaaaa", "x" * 40}
    one, many = lattice.Lattice(PIECES, 4), lattice.Lattice(PIECES, 4)
    words = sorted(words)
    order, scores, losses, counts, flat = many.briefs(words)
    assert sorted(order.tolist()) == list(range(len(words))) and len(many.memo) < len(words) - 1000
    ends = np.cumsum(counts)
    for k, i in enumerate(order.tolist()):
        ids = flat[ends[k] - counts[k] : ends[k]]
        assert (ids.tobytes(), scores[k], losses[k]) == one.brief(words[i])
        first = one.nbest(words[i], 2)
        assert (tuple(ids.tolist()), scores[k]) == (first[0][1], first[0][0]) and losses[k] == (first[0][0] - first[1][0] if len(first) > 1 else math.inf)
    assert many.briefs([])[0].tolist() == []


def test_memo_holds_two_bounded_generations():
    made = []
    memo = Generations(lambda w: made.append(w) or (w.encode(),), 50 * 400, lambda w, v: len(w) + len(v[0]))
    for k in range(1000):
        assert memo[f"w{k}"] == (f"w{k}".encode(),) and memo["often"] == (b"often",)
        assert len(memo) <= 55 and len(memo.older) <= 55
    assert made.count("often") == 1 and memo["y" * 65] and "y" * 65 not in memo


def test_rows_of_a_part_are_those_of_single_texts():
    """Whole parts, by arrays, against each text by itself: ids, scores and round trip; empty texts among them."""
    r = np.random.default_rng(2)
    texts = ["", " ", "▁", "x  y", "日本 ﬀ ²", "\ud800 a"[1:], *(" ".join("".join(r.choice(list("aeinrst.,7"), int(n))) for n in r.integers(1, 12, int(k))) for k in r.integers(0, 60, 80)), ""]
    x, plain = lattice.Lattice(PIECES, 4), lattice.Lattice(PIECES, 4)
    got = [row for part in x.parts(texts) for row in x.rows(part)]
    for t, (n, score, crc, scores, same) in zip(texts, got, strict=True):
        found = plain.encode(t)
        assert (n, score, crc, scores) == (len(found[0][1]) // 4, found[0][0], zlib.crc32(found[0][1]), [y for y, _ in found])
        assert same and plain.decode(np.frombuffer(found[0][1], np.uint32).tolist()) == t.replace("▁", " ")
