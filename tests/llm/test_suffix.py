"""Repeated passages against all windows of all rows, with rows that repeat an id, have none, or are equal."""

import re
from collections import defaultdict

import numpy as np

from linkspark.llm import suffix
from linkspark.llm.common import Words, cut


def words(n: int, seed: int) -> list[str]:
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefgé"), 5)) for _ in range(n)]


def by_windows(rows: list[tuple], least: int) -> list[tuple[list, list]]:
    """repeats and cuts of each row, rows in order of id (none last) and then as they stand."""
    seen = defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        text = rows[k][1] or ""
        at = [m.span() for m in re.finditer(r"\S+", text)]
        for a in range(len(at) - least + 1):
            seen[tuple(text[x:y] for x, y in at[a : a + least])].append((k, at[a][0], at[a + least - 1][1]))
    every, others = defaultdict(list), defaultdict(list)
    for found in seen.values():
        if len(found) > 1:
            for n, (k, a, b) in enumerate(found):
                every[k].append(a << 32 | b)
                if n:
                    others[k].append(a << 32 | b)
    return [(suffix.merged(every[k]), suffix.merged(others[k])) for k in range(len(rows))]


def check(spark, rows, least, files=1):
    """Each row is its own file's, in the order of rows, as equal ids are ordered by their files' hashes otherwise."""
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix.repeats(df, least).collect()
    want = by_windows(rows, least)
    pairs = lambda x: tuple(map(tuple, x))
    made = sorted((str(r["doc_id"]), pairs(r["repeats"]), pairs(r["cuts"])) for r in got)
    assert made == sorted((str(i), pairs(a), pairs(b)) for (i, _), (a, b) in zip(rows, want, strict=True) if a)
    cutout = lambda t, c: t if t is None else "".join(t[x:y] for x, y in zip([0, *(e for _, e in c)], [*(s for s, _ in c), len(t)], strict=True))
    left = suffix.without_repeats(df, least).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(str((i, cutout(t, c))) for (i, t), (_, c) in zip(rows, want, strict=True))


def test_words_are_those_of_split():
    import pyarrow as pa

    texts = ["", " ", "a", " é\x1cb　c d ", "x\x85y", "日本 z" * 30, "w" * 300 + " v", " "] * 3
    for size in (1, 50, 1 << 20):
        for at, w in Words.parts(pa.array(texts), size):
            for k in range(len(w.bounds) - 1):
                i = np.arange(w.word_bounds[k], w.word_bounds[k + 1])
                assert texts[at + k].split() == [texts[at + k][s >> 32 : s & 0xFFFFFFFF] for s in w.spans(i, i).tolist()]


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (words(100, k) for k in range(4))
    text = lambda *x: " ".join(sum(x, []))
    rows = [(1, text(a)), (4, text(b, a[10:70])), (4, text(c)), (5, text(b[20:], words(5, 9))), (None, text(d[:60], a[:49])), (None, text(words(3, 8), d)), (-1, text(c[:80])), (2, None), (2, ""), (3, "x " * 20)]
    check(spark, rows, 50)
    check(spark, rows + rows, 50)
    untouched = suffix.without_repeats(spark.createDataFrame([(4, text(a)), (4, text(b)), (9, text(b[:60]))], "doc_id long, text string"), 50)
    assert {r["text"] for r in untouched.collect()} == {text(a), text(b), text(b[:40])} - {text(b[:40])} | {""}


def test_matches_extend_left_and_right(spark):
    """Passages that share heads but differ before and behind, periodic texts, other white space, and short windows."""
    r = np.random.default_rng(5)
    base, rows = words(300, 40), []
    for i in range(60):
        x, y = sorted(r.integers(0, 300, 2).tolist())
        t = words(int(r.integers(0, 30)), 100 + i) + base[x:y] + words(int(r.integers(0, 30)), 200 + i)
        for k in r.integers(0, max(1, len(t)), int(r.integers(0, 3))).tolist():
            if t:
                t[k] = "edit"
        rows.append((int(r.integers(0, 40)), ("  " if i % 7 == 0 else " ").join(t)))
    rows += [(70 + k, " ".join((["p", "q", "r"] * 60)[: 90 + k])) for k in range(4)] + [(80, "s " * 200)]
    for least in (50, 20, 5, 3):
        check(spark, rows, least)


def test_hot_passage_over_many_ranges(spark):
    """Every row holds one passage: its heads span ranges, whose edges are settled between them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shared = words(60, 7)
        rows = [(i, " ".join(words(3, 1000 + i) + shared + words(i % 9, 2000 + i))) for i in range(120)]
        check(spark, rows, 50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_other_columns_and_long_texts(spark):
    """Columns with the operator's own names stay as they are; a text of a hundred thousand words is searched whole."""
    long = words(100_000, 3)
    rows = [(1, " ".join(long), 7, "a"), (2, " ".join(words(2, 4) + long[99_900:]), 8, "b"), (3, " ".join(long[50_000:50_060]), 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file long, head string")
    out = {r["doc_id"]: r for r in suffix.without_repeats(df, 50).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == " ".join(words(2, 4)) + " " and out[3]["text"] == ""
    assert [(out[k]["file"], out[k]["head"]) for k in (1, 2, 3)] == [(7, "a"), (8, "b"), (9, None)]
    path = cut(df)
    assert suffix.repeats(path, 50).count() == 3


def test_joined_spans_are_those_of_merged():
    r = np.random.default_rng(3)
    for n in (0, 1, 40, 300):
        row = r.integers(0, 9, n)
        start = r.integers(0, 200, n)
        span = start << 32 | start + r.integers(1, 30, n)
        got = suffix.joined(row, span, 10).to_pylist()
        assert [[(x["start"], x["end"]) for x in y] for y in got] == [suffix.merged(span[row == k].tolist()) for k in range(10)]
