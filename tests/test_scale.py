"""Counts and links of blocks too large for pairs of records, against SQL and brute force, with odd ids."""

import random
from collections import Counter

import duckdb
import pytest

from linkspark import catalog
from linkspark.functions import edits
from linkspark.operators import profile

#: Repeated ids (with equal, other and short texts), null ids, texts and sources.
ROWS = [(i, f"the opening of a block {i % 7}", "ab"[i % 2]) for i in range(60)]
ROWS += [(3, "the opening of a block 3", "a"), (4, "another opening of it", "b"), (5, "short", "b"), (6, None, "a"), (None, "the opening of a block 1", "a")]
ROWS += [(70, "another opening of it", None), (71, "another opening of it", "a"), (72, None, "a"), (73, "short", "a"), (70, "another opening of it", "b")]


def equals_sql(spark, folder, name, rows, columns, kind):
    at = folder / f"{name}.parquet"
    spark.sparkContext.setCheckpointDir(str(folder / "checkpoints"))
    spark.createDataFrame(rows, columns).write.parquet(str(at))
    db = duckdb.connect()
    db.sql(f"create view {name} as select * from '{at}/*.parquet'")
    want = db.sql(catalog.SQL[kind])
    got = catalog.QUERIES[kind](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    return got


def test_blocking_measures_from_group_sizes(spark, tmp_path):
    equals_sql(spark, tmp_path, "documents", ROWS, "doc_id long, text string, source string", "blocking_measures")


def test_blocking_measures_form_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.linkage, "candidate_pairs", lambda *_: pytest.fail("pairs formed"))
    n = 200_000
    spark.range(n).selectExpr("id as doc_id", "concat('the opening of a block ', id div 2) as text", "'a' as source").write.parquet(str(tmp_path / "documents.parquet"))
    x = catalog.blocking_measures(spark, str(tmp_path)).first()
    assert (x.candidates, x.hits, x.truth) == (n * (n - 1) // 2, n // 2, n // 2)


def test_records_from_openings_are_those_of_whole_texts(spark, tmp_path):
    texts = ["x" * n + gap + "Yé_Z9" * 60 for n in (0, 150, 199, 200, 700) for gap in ("", " ." * 200, " " * 600, "é" * 900)] + ["", None, "ab" * 99]
    spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(f"with {catalog.DOCS.replace('from documents)', f"from '{tmp_path}/documents.parquet/*.parquet')")} select rid, norm from d order by rid").fetchall()
    assert [(x.rid, x.norm) for x in catalog.doc_records(spark, str(tmp_path)).orderBy("rid").collect()] == want


def test_linkage_quality_from_group_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.linkage, "candidate_pairs", lambda *_: pytest.fail("pairs formed"))
    equals_sql(spark, tmp_path, "documents", ROWS[:60] + ROWS[-6:-1], "doc_id long, text string, source string", "linkage_quality")


def test_distances():
    r = random.Random(3)
    for letters, n in (("ab", 6), ("abcé", 20), ("ab\U0001f600", 100), ("abc", 0)):
        xs, ys = (["pre" + "".join(r.choice(letters) for _ in range(r.randint(0, n))) + "a" for _ in range(25)] for _ in range(2))
        for k, d in edits.distances(xs, ys):
            assert d.tolist() == [plain(x, ys[k]) for x in xs]


def plain(x: str, y: str) -> int:
    row = list(range(len(x) + 1))
    for j, c in enumerate(y, 1):
        new = [j]
        for i, e in enumerate(x, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != e)))
        row = new
    return row[-1]


def test_cluster_differences_by_tiles(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = [(r.randint(0, 250), r.choice((1, 11, None)), "Customer" * r.randint(0, 1) + "%03d" % r.randint(0, 300), r.choice(("A", "1A", None))) for _ in range(400)]
    monkeypatch.setattr(profile.tiles.tiled, "__defaults__", (40,))  # 1 || 1A and 11 || A are one block
    equals_sql(spark, tmp_path, "customer", rows, "c_custkey long, c_nationkey int, c_name string, c_mktsegment string", "cluster_differences")


def test_differences_of_several_columns(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(6)
    rows = [(k // 2 if k < 20 else k, "gh"[k % 3 // 2], r.choice(("", None, "ab", "ba", "abc")), r.choice(("x", "yx", None)), r.randint(0, 1)) for k in range(120)]
    monkeypatch.setattr(profile.tiles.tiled, "__defaults__", (7,))
    want = Counter(), Counter()
    for x in rows:
        for y in rows:
            if x[1] == y[1] and x[0] < y[0]:
                wrong = sum(a != b for a, b in zip(x[2:], y[2:], strict=True))
                want[0][wrong] += 1
                want[1][wrong] += sum(plain(str(a or "") if a != 0 else "0", str(b or "") if b != 0 else "0") for a, b in zip(x[2:], y[2:], strict=True))
    got = profile.differences(spark.createDataFrame(rows, "rid int, gid string, a string, b string, c int"), ["a", "b", "c"]).collect()
    assert {x.errors: (x.pairs, x.distance) for x in got} == {k: (n, want[1][k]) for k, n in want[0].items()}


def copies() -> list:
    """Blocks of near copies, some about at the threshold, in one block of over a hundred and many small ones."""
    r, rows = random.Random(7), []
    for k in range(160):
        base = random.Random(k % 9).choices("abcdefgh ", k=random.Random(k % 9).choice((20, 90, 190)))
        for at in r.sample(range(len(base)), r.randint(0, len(base) // 12)):
            base[at] = "z"
        rows.append((k, "The opening " * (k % 5 > 0) + f"block number {k % 9}" + "".join(base), "ab"[k % 2]))
    return rows


@pytest.mark.parametrize("size", [4096, 30])
def test_link_documents_by_tiles(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(profile.tiles.tiled, "__defaults__", (size,))
    got = equals_sql(spark, tmp_path, "documents", copies() + [(3, copies()[8][1], "b"), (None, copies()[1][1], "a"), (500, None, "a"), (501, "short", "a")], "doc_id long, text string, source string", "link_documents")
    assert 10 < len({x[1] for x in got}) < 130


def test_links_count_few_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.linkage, "candidate_pairs", lambda *_: pytest.fail("pairs formed"))
    rows = [(k, "the opening of one block" + "".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=170))) for k in range(6000)]
    rows += [(10_000 + k, t[:100] + "%04d" % k + t[104:]) for k, t in rows[:50]]
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    spark.createDataFrame([(*x, "a") for x in rows], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.rid: x.cluster_id for x in catalog.link_documents(spark, str(tmp_path)).collect()}
    assert got == {k: k % 10_000 for k, _ in rows}
