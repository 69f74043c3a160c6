"""Near duplicates by row: repeated ids with equal or different texts, rows without an id, clashing names."""

import numpy as np

from linkspark.llm import minhash


def prose(n: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))


A, B, C = prose(90, 1), prose(90, 2), prose(90, 3)
A1, B1 = A + " tail", B + " end"
SCHEMA = "doc_id long, text string, file long, first string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).coalesce(1)


def components(spark, rows, words=5):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(table(spark, rows), words=words).collect())


def kept(spark, rows):
    out = minhash.without_near_duplicates(table(spark, rows)).collect()
    assert all((r["file"], r["first"]) == (5, "x") for r in out)
    return sorted(((str(r["doc_id"]), r["text"]) for r in out), key=str)


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    got = components(spark, [(5, A), (5, B), (7, A1), (9, B1)])
    assert [x[2] for x in got] == ["5", "5", "5", "5"] and [x[3] for x in got] == [True, True, False, False]
    assert components(spark, [(8, B1), (8, C), (2, B)]) == [("2", 86, "2", True), ("8", 86, "8", True), ("8", 87, "2", False)]


def test_one_row_of_each_group_stays(spark):
    assert kept(spark, [(1, A), (1, A)]) == [("1", A)]
    assert kept(spark, [(8, B1), (8, C), (2, B)]) == sorted([("8", C), ("2", B)], key=str)
    assert kept(spark, [(5, A), (5, B), (7, A1), (9, B1)]) == sorted([("5", A), ("5", B)], key=str)
    assert kept(spark, [(3, ""), (3, None), (4, " "), (4, "one"), (6, "ONE")]) == sorted([("3", ""), ("3", None), ("4", " "), ("4", "one")], key=str)


def test_rows_without_an_id(spark):
    rows = [(None, A), (None, A1), (None, ""), (None, B), (4, B1), (None, C)]
    assert components(spark, rows) == [("4", 87, "4", True), ("None", 0, "None", True), ("None", 86, "4", False), ("None", 86, "None", True), ("None", 86, "None", True), ("None", 87, "None", True)]
    assert kept(spark, rows) == sorted([("None", A), ("None", ""), ("4", B1), ("None", C)], key=str)


def test_all_rows_equal_and_no_rows(spark):
    assert kept(spark, [(k % 3, A) for k in range(60)]) == [("0", A)]
    assert components(spark, [(k, A) for k in range(3)]) == [("0", 86, "0", True), ("1", 86, "0", False), ("2", 86, "0", False)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0 and minhash.without_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
