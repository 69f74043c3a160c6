"""Scalar functions and linkage operators on fixed values and small tables."""

import pytest
from pyspark.sql import functions as F

from linkspark.functions import features, hashing, normalize, similarity
from linkspark.operators import linkage


def value(spark, c, **fields):
    names = ", ".join(f"{k} string" for k in fields)
    return spark.createDataFrame([tuple(fields.values())], names).select(c).first()[0]


def test_random_hashing_matches_the_class_library():
    assert hashing.keyed_seed("SECRET", "test") == 772471595764144153
    assert hashing.random_positions("test", 10, 1024) == [305, 111, 759, 724, 823, 539, 926, 164, 11, 402]
    assert hashing.random_positions("test", 10, 1024, secure=False) == [423, 716, 696, 886, 787, 364, 297, 611, 949, 148]
    assert hashing.random_positions("__SLN_", 5, 1024) == [872, 346, 457, 455, 811]
    assert hashing.positive_int("SMITH") == 1932594580 and hashing.positive_int("SMITH") % 64 == 20


@pytest.mark.parametrize(("seed", "want"), [(42, "4 6 2 1 7 9 8 5 3 0"), (43, "4 7 2 0 1 5 3 9 8 6"), (84, "2 9 3 7 5 1 6 0 4 8"), (85, "2 3 8 6 5 0 9 1 7 4")])
def test_shuffle(seed, want):
    assert hashing.shuffled(10, seed) == [int(x) for x in want.split()]


def test_double_hashing(spark):
    assert value(spark, hashing.double_hashes(F.col("t"), 5, 1024), t="_SMFN_") == [220, 896, 548, 200, 876]
    with pytest.raises(ValueError, match="positions need"):
        hashing.standard_hashes(F.col("t"), 4, 1024, ("md5", "sha1"))


def test_normalisers(spark):
    x = lambda f, t: value(spark, f(F.col("t")), t=t)
    assert x(normalize.trim, "\t a b \x01") == "a b"
    assert x(normalize.accents_removed, "Łódź café") == "Lodz cafe"
    assert x(normalize.umlauts_spelled, "Größe") == "Groesse"
    assert x(normalize.service_text, " Müller-Lüdenscheidt von der Aue ") == "MULLERLUDENSCHEIDTVO"
    assert x(normalize.service_number, " 04-109 ") == "04109"
    assert x(normalize.gender, "Female") == "fem" and x(normalize.gender, "male") == "mal"
    assert x(normalize.null_removed, "a NULL b") == ""
    assert value(spark, normalize.merge(["a", "b", "y"], "."), a="20", b="07", y="1975") == "20.07.1975"
    assert value(spark, F.array(*normalize.split_parts(F.col("t"), " ", 2)), t="04109 Leipzig") == ["04109", "Leipzig"]


def test_features(spark):
    x = lambda e, t: value(spark, e(F.col("t")), t=t)
    assert x(features.qgrams(3, "_"), "SMITH") == ["__S", "_SM", "SMI", "MIT", "ITH", "TH_", "H__"]
    assert x(features.qgrams(3), "AB") == ["AB"]
    assert x(features.integer_range(1, 12, 2), "12") == ["12", "1", "11", "2", "10"]
    assert x(features.split_by(","), "a,b,,") == ["a", "b"]


def test_similarities(spark):
    x = lambda f, a, b: value(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert x(similarity.levenshtein, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert x(similarity.jaro_winkler, "MARTHA", "MARHTA") == pytest.approx(0.9611111)
    assert x(similarity.containment, "abc", "xabcx") == 1 and x(similarity.exact, "a", "b") == 0 and x(similarity.prefix, "", "b") == 0


def test_best_matches_and_components(spark):
    links = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "y", 0.7), ("c", "z", 0.5)], "l string, r string, sim double")
    assert {(r["l"], r["r"]): r["strength"] for r in linkage.link_strength(links).collect()} == {("a", "x"): "STRONG", ("a", "y"): "NORMAL", ("b", "x"): "WEAK", ("b", "y"): "WEAK", ("c", "z"): "STRONG"}
    assert {(r["l"], r["r"]) for r in linkage.greedy_matching(links).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert {r["node"]: r["component"] for r in linkage.connected(links).collect()} == {"a": "a", "b": "a", "x": "a", "y": "a", "c": "c", "z": "c"}


def test_blocking_measures(spark):
    records = spark.createDataFrame([("a1", "A", "g1", True), ("a2", "A", "g2", True), ("b1", "B", "g1", True)], "rid string, party string, gid string, duplicate_free boolean")
    keys = spark.createDataFrame([(r, k, "v") for r in ("a1", "a2", "b1") for k in (0, 1)], "rid string, key_id int, key_value string")
    pairs = linkage.candidate_pairs(records, keys)
    assert {(r["l"], r["r"]) for r in pairs.collect()} == {("a1", "b1"), ("a2", "b1")}
    assert linkage.blocking_quality(records, pairs).first()["hits"] == 1
