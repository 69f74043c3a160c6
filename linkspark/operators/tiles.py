"""Pairs of the rows of a block, whatever its size, as tiles that a task can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of a part of a block, about; a tile holds two parts.
SIZE = 4096


def tiled(rows: DataFrame, run: Callable[[dict, list], Iterable[tuple]], schema: str, size: int = SIZE) -> DataFrame:
    """What `run` yields for the pairs of rows within each `block`; rows are read several times, so write them first.

    Blocks of more than `size` rows are split by hash in parts, and each two of these (each with itself, too) are a tile of
    their own; smaller blocks share tasks. run gets the columns of a task as lists, and tiles of two lists of
    places: equal ones where all pairs within are meant, else two parts of one block.
    """
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("held")).where("held > 1").withColumn("parts", F.ceil(F.col("held") / size)).checkpoint()
    split = F.col("parts") > 1
    small, wide = blocks.agg(F.coalesce(F.sum(F.when(~split, F.col("held"))), F.lit(0)), F.coalesce(F.sum(F.when(split, F.expr("parts * (parts + 1) div 2"))), F.lit(0))).first()
    count = small // size + 1 + wide
    tasks = min(count, max(200, count // 16))  # by their work: their bytes are few
    x = rows.join(blocks, "block").withColumn("part", F.pmod(F.xxhash64(*rows.columns), "parts"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    bin_ = F.when(~split, F.pmod(F.xxhash64(F.lit(1), "block"), F.lit(small // size + 1)))
    x = x.select(*rows.columns, "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), F.when(split, F.col("block")).alias("wide"), bin_.alias("bin"))

    columns, kind = rows.columns, _parse_datatype_string(schema)
    names, arrow = kind.names, to_arrow_schema(kind)

    def work(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_pylist() for k in (*columns, "part")}
        order = sorted(range(t.num_rows), key=lambda k: (c["block"][k], c["part"][k]))
        tiles = []
        for _, own in groupby(order, key=lambda k: c["block"][k]):
            sides = [list(p) for _, p in groupby(own, key=lambda k: c["part"][k])]
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            if i == j or len(sides) == 2:  # else one of the parts is empty
                tiles.append((sides[0], sides[-1]))
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in run(c, tiles)], schema=arrow)

    by = ["bin", "wide", "i", "j"]
    return x.repartition(tasks, *by).groupBy(*by).applyInArrow(work, kind)
