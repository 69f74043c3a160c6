import json

import pytest
from pyspark.sql import functions as F

from linkspark.functions.similarity import words_of
from linkspark.plans import incremental
from linkspark.sources import files
from linkspark.streaming import rounds


def test_delimited_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;"a;""b""";2020-01-02;x\n2;;oops;y\n')
    got = files.read_records(spark, str(tmp_path / "a.csv"), [("id", "int"), ("name", "string"), ("born", "date")]).collect()
    assert [(r.id, r.name, str(r.born)) for r in got] == [(1, 'a;"b"', "2020-01-02"), (2, None, "None")]
    with pytest.raises(ValueError):
        files.read_records(spark, str(tmp_path / "a.csv"), [("c", "string")] * 9)
    with pytest.raises(ValueError):
        files.read_table(spark, "jdbc:x", "a; drop", ["a"])


def test_link_table_file(spark, tmp_path):
    x = spark.createDataFrame([(1, "A", 'A"1', None, True)], "cluster_id bigint, party string, record_id string, global_id string, party_dirty boolean")
    assert files.link_lines(x).first().value == '1,"A","A""1","",true'
    files.write_links(x, str(tmp_path / "l"))
    assert files.read_links(spark, str(tmp_path / "l")).first()[:3] == (1, "A", 'A"1')
    p = spark.createDataFrame([("A", True), ("AB", False)], "name string, dirty boolean")
    ids = spark.createDataFrame([("A1",), ("AB1",)], "record_id string")
    assert {r.record_id: r.party for r in files.with_party(ids, p).collect()} == {"A1": "A", "AB1": "AB"}


def test_histogram_file(spark, tmp_path):
    x = files.histogram_table(spark.createDataFrame([("match", 3, 7)], "truth string, bin int, n bigint"), 4)
    assert x.count() == 8 and x.where("count > 0").first()[:] == ("match", "0.7500", "1.0000", 7)
    files.write_records(x, str(tmp_path / "h"))
    assert {(r.bin_low, r.matches, r.others) for r in files.read_histogram(spark, str(tmp_path / "h")).collect()} == {(0.0, 0, 0), (0.25, 0, 0), (0.5, 0, 0), (0.75, 7, 0)}


def test_graphs(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a;b;0.5\na;z;0.9\n")
    known = spark.createDataFrame([("a",), ("b",)], "rid string")
    edges = files.read_edges(spark, str(tmp_path / "e.csv"), known)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 0.5)]
    files.write_graph(known, edges, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"))[1].count() == 1


def test_payloads(spark):
    x = spark.createDataFrame([("1", "A", [0, 70]), ("2", "A", [])], "rid string, party string, p array<int>").select("rid", "party", words_of(F.col("p"), 2).alias("words"))
    back = files.decoded(files.encoded(x, 2), 2)
    assert {r.rid: r.words for r in back.collect()} == {"1": [1, 64], "2": [0, 0]}


def test_round(spark, tmp_path):
    at, line = tmp_path / "in", lambda party, i, h="h": json.dumps({"run_id": "r1", "party": party, "sent": "2024-01-01T00:00:00Z", "config_hash": h, "bit_length": 64, "records": [{"id": f"{party}{i}", "bits": "AQ=="}]})
    at.mkdir()
    (at / "1.json").write_text(line("A", 1) + "\n" + line("A", 1) + "\n")
    (at / "2.json").write_text(line("B", 1) + "\n")
    rounds.collect_round(spark, str(at), str(tmp_path / "store"), str(tmp_path / "state"))
    (at / "3.json").write_text(line("A", 1) + "\n" + line("C", 1, "other") + "\n")
    got = spark.read.parquet(str(tmp_path / "store"))
    assert rounds.complete_runs(got, ["A", "B", "C"]).first().missing == ["C"]
    assert rounds.guarded(got, "h").count() == 2
    rounds.collect_round(spark, str(at), str(tmp_path / "store"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "store"))
    assert sorted(r.id for r in got.collect()) == ["A1", "B1", "C1"]
    assert rounds.complete_runs(got, ["A", "B", "C"]).first().complete
    with pytest.raises(Exception, match="encodings differ"):
        rounds.guarded(got).collect()
    assert rounds.unknown(got, spark.createDataFrame([("A1",)], "rid string")).count() == 2


def test_incremental_plan(spark):
    history = spark.createDataFrame([("h1", "A", "c1"), ("h2", "B", "c2"), ("h3", "D", "c3")], "rid string, party string, cluster_id string")
    fresh = spark.createDataFrame([("x1", "A"), ("x2", "B"), ("x3", "D"), ("x4", "D"), ("x5", "B"), ("x6", "D")], "rid string, party string")
    own = spark.createDataFrame([("x3", "x4")], "l string, r string")
    links = spark.createDataFrame([("x1", "h1", 0.9), ("x1", "h2", 0.8), ("x2", "h1", 0.7), ("x5", "h1", 0.75), ("x5", "h3", 0.6), ("x3", "h3", 0.9), ("x4", "h2", 0.95)], "l string, r string, sim double")
    got = {r.rid: r.cluster_id for r in incremental.plan(fresh, history, own, links, ["A", "B"]).collect()}
    # A is in c1 already, so x1 goes to c2; x2 and x5 (B) compete for c1, and x5 may take c3 instead.
    assert got == {"h1": "c1", "h2": "c2", "h3": "c3", "x1": "c2", "x2": "c1", "x5": "c3", "x3": "c2", "x4": "c2", "x6": "x6"}


def test_candidates(spark):
    keys = "rid string, key_id int, key_value string"
    f = spark.createDataFrame([("x1", "A", True), ("x2", "B", False)], "rid string, party string, duplicate_free boolean")
    h = spark.createDataFrame([("h1", "A", "c1"), ("h2", "B", "c2")], "rid string, party string, cluster_id string")
    fk = spark.createDataFrame([("x1", 0, "k"), ("x1", 1, "m"), ("x2", 0, "k")], keys)
    hk = spark.createDataFrame([("h1", 0, "k"), ("h2", 0, "k"), ("h2", 1, "m")], keys)
    got = {tuple(r) for r in incremental.candidates(fk, hk, h, f).collect()}
    assert got == {("x1", "h2"), ("x2", "h1"), ("x2", "h2")}
    assert {r.cluster_id for r in incremental.touched(hk, h, fk).collect()} == {"c1", "c2"}
