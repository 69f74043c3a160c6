"""Fresh records join frozen clusters: candidates by key, scores of groups and clusters, and the assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import linkage
from ..operators.matching import assignment


def candidates(fresh_keys: DataFrame, history_keys: DataFrame, history: DataFrame, fresh: DataFrame) -> DataFrame:
    """l (fresh), r (history): distinct pairs that share a key, unless a clean party of the fresh record is in r's cluster.

    Keys are (rid, key_id, key_value); history is (rid, party, cluster_id), fresh (rid, party, duplicate_free).
    """
    a = fresh_keys.join(fresh.select("rid", "party", "duplicate_free"), "rid").withColumnRenamed("rid", "l")
    b = history_keys.join(history.select("rid", "cluster_id"), "rid").withColumnRenamed("rid", "r")
    x = a.join(b, ["key_id", "key_value"]).select("l", "r", "party", "duplicate_free", "cluster_id").distinct()
    held = history.select("cluster_id", "party").distinct().withColumn("duplicate_free", F.lit(True))
    return x.join(held, ["cluster_id", "party", "duplicate_free"], "left_anti").select("l", "r")


def touched(history_keys: DataFrame, history: DataFrame, fresh_keys: DataFrame) -> DataFrame:
    """cluster_id of clusters that share a key with a fresh record."""
    x = history_keys.join(fresh_keys.select("key_id", "key_value").distinct(), ["key_id", "key_value"], "left_semi")
    return x.join(history.select("rid", "cluster_id"), "rid").select("cluster_id").distinct()


def scores(links: DataFrame, groups: DataFrame, history: DataFrame) -> DataFrame:
    """g, cluster_id, sim (largest), mean, shared (links), weight: of links (l fresh, r history, sim).

    A column n, if there is one, is the number of equal links that a row stands for.
    """
    n = F.col("n") if "n" in links.columns else F.lit(1)
    x = links.withColumn("n", n.cast("long")).join(groups.withColumnRenamed("rid", "l"), "l").join(history.select(F.col("rid").alias("r"), "cluster_id"), "r")
    x = x.groupBy("g", "cluster_id").agg(F.max("sim").alias("sim"), (F.sum(F.col("sim") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("shared"))
    return x.withColumn("weight", F.col("sim") + 1e-6 * F.col("mean") + 1e-9 * F.col("shared"))


def optimal(scored: DataFrame) -> DataFrame:
    """g, cluster_id: each group in at most one cluster and each cluster with at most one group, of the largest weight.

    Groups that compete for clusters are one grouped call.
    """
    key = lambda c, side: F.concat(F.lit(side), F.col(c).cast("string"))
    parts = linkage.connected(scored.select(key("g", "g").alias("l"), key("cluster_id", "c").alias("r")))
    x = scored.withColumn("node", key("g", "g")).join(parts, "node").select("component", "g", "cluster_id", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="g", columns="cluster_id", values="weight").fillna(0.0).sort_index().sort_index(axis=1)
        return pd.DataFrame([(w.index[i], w.columns[j]) for i, j in assignment(w.to_numpy())], columns=["g", "cluster_id"])

    kinds = [scored.schema[c].dataType.simpleString() for c in ("g", "cluster_id")]
    return x.groupBy("component").applyInPandas(run, f"g {kinds[0]}, cluster_id {kinds[1]}")


def plan(fresh: DataFrame, history: DataFrame, fresh_links: DataFrame, links: DataFrame, clean: list[str]) -> DataFrame:
    """rid, party, cluster_id of all records: history as it was, fresh groups in a cluster of history or in new ones.

    fresh (rid, party); fresh_links (l, r) have been made source-consistent, so that a group holds one record of a clean
    party at most. A group without clean records joins its best cluster (weight, then the smaller id). For each clean
    party in alphabetical order the groups that hold it are assigned at best to clusters without it; a group's other
    clean parties bar clusters too. What is left becomes a cluster named by its smallest rid, which must be a new id.
    """
    groups = linkage.link_table(fresh, fresh_links).select("rid", F.col("cluster_id").alias("g")).checkpoint()
    scored = scores(links, groups, history).checkpoint()
    parties = fresh.where(F.col("party").isin(clean)).join(groups, "rid").select("g", "party").distinct().checkpoint()
    held = history.where(F.col("party").isin(clean)).select("cluster_id", "party").distinct()
    best = Window.partitionBy("g").orderBy(F.desc("weight"), "cluster_id")
    loose = scored.join(parties.select("g").distinct(), "g", "left_anti")
    chosen = loose.withColumn("n", F.row_number().over(best)).where("n = 1").select("g", "cluster_id")
    for party in sorted(clean):
        own = parties.where(F.col("party") == party).select("g")
        taken = held.union(chosen.join(parties, "g").select("cluster_id", "party"))
        barred = parties.join(taken, "party").select("g", "cluster_id").distinct()
        open_ = scored.join(own, "g", "left_semi").join(chosen.select("g"), "g", "left_anti").join(barred, ["g", "cluster_id"], "left_anti")
        chosen = chosen.union(optimal(open_.checkpoint())).checkpoint()
    x = fresh.select("rid", "party").join(groups, "rid").join(chosen, "g", "left")
    return history.select("rid", "party", "cluster_id").unionByName(x.select("rid", "party", F.coalesce("cluster_id", "g").alias("cluster_id")))
