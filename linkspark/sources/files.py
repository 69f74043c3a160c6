"""Readers and writers: delimited records, link tables, histograms, graphs, databases, encoded payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

# Column names of the link table's file.
LINK_COLUMNS = ("cluster_id", "party", "record_id", "global_id", "party_dirty")
CSV = {"quote": '"', "escape": '"', "multiLine": True}


def read_records(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = False, sep: str = ";") -> DataFrame:
    """The first columns by position, named and cast; a value that isn't of its type is null. `columns`: (name, SQL type).

    Quoted values may hold line ends, so a file is one task: large inputs come as many files.
    """
    raw = spark.read.csv(path, sep=sep, header=header, **CSV)
    if len(raw.columns) < len(columns):
        raise ValueError(f"{len(columns)} columns are declared; the file has {len(raw.columns)}")
    plain = raw.toDF(*(f"_c{i}" for i in range(len(raw.columns))))
    return plain.select(*(F.col(f"_c{i}").try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)))


def read_table(spark: SparkSession, url: str, table: str, columns: list[str], **options: str) -> DataFrame:
    """A table of a database by position; null is the empty text. Name partitionColumn and bounds to read in parallel."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", table):
        raise ValueError(f"not a table name: {table!r}")
    x = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return x.toDF(*columns, *x.columns[len(columns) :]).select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_records(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, **{k: v for k, v in CSV.items() if k != "multiLine"})


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def link_lines(table: DataFrame) -> DataFrame:
    """value: lines of a link table (cluster_id, party, record_id, global_id, party_dirty); texts are quoted, id and flag are not."""
    c = [F.col("cluster_id").cast("string"), *(quoted(F.col(x)) for x in LINK_COLUMNS[1:4]), F.col("party_dirty").cast("string")]
    return table.select(F.concat_ws(",", *c).alias("value"))


def write_links(table: DataFrame, path: str) -> None:
    """Part files without a header; read_links names the columns."""
    link_lines(table).write.text(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    kinds = ("bigint", "string", "string", "string", "boolean")
    return spark.read.csv(path, schema=", ".join(f"{n} {k}" for n, k in zip(LINK_COLUMNS, kinds, strict=True)), **CSV)


def with_party(links: DataFrame, parties: DataFrame) -> DataFrame:
    """record_id, party: the party (name, dirty) with the longest name that begins the id; parties are few by nature."""
    ids = links.select("record_id").distinct()
    x = ids.join(F.broadcast(parties), F.startswith("record_id", F.col("name")))
    return x.groupBy("record_id").agg(F.max_by("name", F.char_length("name")).alias("party"), F.max_by("dirty", F.char_length("name")).alias("party_dirty"))


def histogram_table(counted: DataFrame, bins: int) -> DataFrame:
    """truth, bin_low, bin_high, count: every bin of both kinds, empty ones too, bounds with four digits. From (truth, bin, n)."""
    spark = counted.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(spark.createDataFrame([("match",), ("non_match",)], "truth string"))
    x = grid.join(counted, ["truth", "bin"], "left")
    edge = lambda b: F.format_string("%.4f", b / F.lit(float(bins)))
    return x.select("truth", edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("count"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """bin_low, bin_high, matches, others."""
    x = spark.read.csv(path, header=True, schema="truth string, bin_low double, bin_high double, count bigint")
    n = lambda t: F.coalesce(F.sum(F.when(F.col("truth") == t, F.col("count"))), F.lit(0))
    return x.groupBy("bin_low", "bin_high").agg(n("match").alias("matches"), n("non_match").alias("others"))


def read_edges(spark: SparkSession, path: str, records: DataFrame | None = None, sep: str = ";") -> DataFrame:
    """l, r, sim of a file of edges; only between the records (rid), if given."""
    x = spark.read.csv(path, sep=sep, schema="l string, r string, sim double", **CSV)
    if records is not None:
        for end in ("l", "r"):
            x = x.join(records.select(F.col("rid").cast("string").alias(end)).distinct(), end, "left_semi")
    return x.select("l", "r", "sim")


def read_json_graph(spark: SparkSession, path: str, vertex: str, pair: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, party and the fields of `vertex`, a SQL struct) and edges (l, r, sim) of JSON lines, of a pair of parties only if given."""
    v = spark.read.json(f"{path}/vertices", schema=f"id string, data {vertex}").select("id", "data.*")
    e = spark.read.json(f"{path}/edges", schema="source string, target string, data struct<value: double>").select(F.col("source").alias("l"), F.col("target").alias("r"), F.col("data.value").alias("sim"))
    if pair:
        v = v.where(F.col("party").isin(*pair))
        p = v.select("id", "party")
        e = e.join(p.select(F.col("id").alias("l"), F.col("party").alias("lp")), "l").join(p.select(F.col("id").alias("r"), F.col("party").alias("rp")), "r")
        e = e.where((F.col("lp") == pair[0]) & (F.col("rp") == pair[1])).select("l", "r", "sim")
    return v, e


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def encoded(records: DataFrame, n: int, with_gid: bool = False) -> DataFrame:
    """id, party, bits (Base64), and the global id only if asked for: the form in which vectors leave their owner."""
    return records.select(F.col("rid").cast("string").alias("id"), *(["gid"] if with_gid else []), "party", bits.to_base64(F.col("words"), n).alias("bits"))


def decoded(payload: DataFrame, n: int) -> DataFrame:
    gid = F.col("gid") if "gid" in payload.columns else F.lit(None).cast("string")
    return payload.select(F.col("id").alias("rid"), gid.alias("gid"), "party", bits.from_base64(F.col("bits"), n).alias("words"))
