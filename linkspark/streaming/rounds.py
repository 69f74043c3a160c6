"""Rounds of linkage: payloads of parties arrive at least once; the first of each party in a run counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "run_id string, party string, sent timestamp, config_hash string, bit_length int, records array<struct<id: string, gid: string, bits: string>>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of payload files, JSON, one payload a line."""
    return spark.readStream.schema(PAYLOAD).json(path)


def first_payloads(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """One payload for each run and party. State is kept as long as a repetition may come, by the time of sending."""
    return stream.withWatermark("sent", late).dropDuplicatesWithinWatermark(["run_id", "party"])


def first_received(received: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of a table of payloads that arrived at least once, the first by `order` of each of `keys`, whole rows."""
    row = F.struct(*(F.col(c) for c in received.columns))
    return received.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def records_of(payload: DataFrame) -> DataFrame:
    return payload.select("run_id", "party", "config_hash", "bit_length", F.explode("records").alias("x")).select("run_id", "party", "config_hash", "bit_length", "x.*")


def collect_round(spark: SparkSession, path: str, store: str, state: str, late: str = "1 day") -> None:
    """Appends all that has arrived to the store, a run a folder, exactly once, and ends."""
    x = records_of(first_payloads(payloads(spark, path), late))
    q = x.writeStream.format("parquet").option("path", store).option("checkpointLocation", state).partitionBy("run_id").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def complete_runs(received: DataFrame, parties: list[str]) -> DataFrame:
    """run_id, complete, missing: whether all parties of a run have sent."""
    x = received.where(F.col("party").isin(parties)).groupBy("run_id").agg(F.collect_set("party").alias("there"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, parties)), F.col("there")))
    return x.select("run_id", (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def guarded(received: DataFrame, stored_hash: str | None = None) -> DataFrame:
    """The records; the job fails if parties of a run were encoded by different configurations, or by another than stored.

    An aggregate of one row a run is joined; runs open at a time are few, so Spark may broadcast it by its measured size.
    """
    h = received.groupBy("run_id").agg(F.min("config_hash").alias("lo"), F.max("config_hash").alias("hi"))
    ok = F.col("lo") == F.col("hi")
    if stored_hash is not None:
        ok &= F.col("lo") == stored_hash
    h = h.select(F.col("run_id"), F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("encodings differ in run "), "run_id")).cast("boolean")).alias("ok"))
    return received.join(h, "run_id").where("ok").drop("ok")


def unknown(received: DataFrame, history: DataFrame) -> DataFrame:
    """Records whose id the history (rid) doesn't hold."""
    return received.join(history.select(F.col("rid").alias("id")).distinct(), "id", "left_anti")
