"""Cumulative-snapshot collapse of logged conversations, and rendering of those that stay. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n, role, text, prefix: turns in order with the rolling hash of all turns up to each.

    The hash is the running sum, kept exactly in a decimal, of two 64-bit hashes of each turn that hold its position.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(own))
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), "pos", "role", "text").cast("decimal(20,0)")).over(run)
    return rows.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("conv_id")), "h1": wide(1), "h2": wide(2)}).select(
        "conv_id", "pos", "n", "role", "text", F.concat_ws(":", F.col("h1").cast("string"), F.col("h2").cast("string")).alias("prefix")
    )


def maximal(t: DataFrame) -> DataFrame:
    """conv_id, copies: one conversation (the smallest id) of each content that no longer one begins with."""
    classes = t.where("pos = n").groupBy(F.col("pos"), F.col("prefix")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    begun = t.where("pos < n").select("pos", "prefix").distinct()
    return classes.join(begun, ["pos", "prefix"], "left_anti").select("conv_id", "copies")


def format_chats(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, copies, rendered of the maximal conversations.

    A conversation that is a proper prefix of a longer one goes; of equal ones the smallest conv_id stays, with their
    number as copies. Turns are in the order of turn, role, text; null roles and texts count as empty; rows with a null
    conv_id are one conversation (null); repeated rows are repeated turns; an empty table gives no rows.
    """
    t = turns(conversations)
    line = F.concat(F.lit(opening), F.col("x.role"), F.lit("\n"), F.col("x.text"), F.lit(closing), F.lit("\n"))
    kept = t.join(maximal(t).withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return (
        kept.withColumn("x", F.struct("pos", "role", "text"))
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select("conv_id", "n_turns", "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
    )


SQL = """
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
t as (select *, row_number() over (partition by conv_id order by turn, role, text) as pos, count(*) over (partition by conv_id) as n from r),
p as (select conv_id, pos, n, string_agg(role || chr(31) || text, chr(30)) over (partition by conv_id order by pos rows between unbounded preceding and current row) as prefix from t),
c as (select pos, prefix, min(conv_id) as conv_id, count(*) as copies from p where pos = n group by pos, prefix),
k as (select conv_id, copies from c where not exists (select 1 from p where p.pos = c.pos and p.prefix = c.prefix and p.pos < p.n))
select t.conv_id, count(*) as n_turns, max(k.copies) as copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) as rendered
from t join k using (conv_id) group by t.conv_id
"""
