"""Suffix-array dedup: sparse suffixes at minimisers, sorted, compared with their neighbours, and extended to whole passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, freeing, mix, numbered, run_hashes, texts, U, Words

#: A window of WINDOW grams of GRAM words has one retained suffix.
GRAM, WINDOW = 4, 30
#: Bytes of text whose words are handled at once, and class representatives (80 bytes each) that are broadcast at most.
PART, FEW = 1 << 20, 100_000
#: Where an occurrence stands: rows without an id come last, rows that repeat an id by their place in the files.
PLACE = ["no_id", "doc_id", "file", "nth", "span"]
ROW = "head long, ctx long, no_id boolean, doc_id long, file long, nth long, span long"


def spread(least: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window, for passages of `least` words."""
    gram = min(GRAM, least)
    return gram, min(WINDOW, least - gram + 1)


def retained(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, low, high: the retained suffixes' first words, and the first and last start of the windows that they stand for.

    Every window of `least` words within a text retains the suffix at its least hashed gram, of equal ones the first.
    Those of consecutive windows never go back, so a suffix stands for a run of windows.
    """
    gram, window = spread(least)
    none = np.zeros(0, np.int64)
    if w.n < least:
        return none, none, none
    grams = run_hashes(w.sums(1), 1, np.arange(w.n - gram + 1), gram)
    least_of = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    held, width = least_of, 1
    while 2 * width <= window:
        held, width = np.minimum(held[:-width], held[width:]), 2 * width
    if rest := window - width:
        held = np.minimum(held[:-rest], held[rest:])
    starts = np.flatnonzero(w.ends_of()[: w.n - least + 1] - np.arange(w.n - least + 1) >= least)
    if not len(starts):
        return none, none, none
    at = (held[starts] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], starts[first], starts[last]


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """ROW for every retained suffix of docs (file, nth, doc_id, text).

    head is the hash of the first words that each of its windows holds, ctx that of the text of all its windows, white
    space included, and span the place of that text in code points, start * 2**32 + end.
    """
    gram, window = spread(least)
    size = least - window + 1

    def run(batches):
        for b in batches:
            for at, w in Words.parts(b.column("text"), PART):
                p, low, high = retained(w, least)
                row = at + w.text_of[low]
                take = lambda c: b.column(c).take(pa.array(row))
                ids = take("doc_id")
                spans = w.spans(low, high + least - 1)
                ctx = mix(run_hashes(w.sums(2), 2, low, high + least - 1 - low) + w.h[high + least - 1] * U(0xD1342543DE82EF95) + (high - low).astype(np.uint64))
                cols = [run_hashes(w.sums(1), 1, p, size).view(np.int64), ctx.view(np.int64), ids.is_null(), ids, take("file"), take("nth"), spans]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], [*ROW.replace(",", "").split()[::2]])

    return docs.mapInArrow(freeing(run), ROW)


def neighbours(rows: DataFrame, keys: list[str], inner: list[str]) -> DataFrame:
    """rows in the order of keys, inner and PLACE, with `before` and `after`: whether the row before or behind has equal
    keys, and `again`: whether that before has equal keys and inner. Rows without an equal neighbour are left out where
    inner is given.

    Ranges of the sorted rows stream through tasks, so that a key which very many rows share is spread over many. What
    the first row of a range follows is settled by the last row of the range before it: two rows a range come to the driver.
    """
    order = [*keys, *inner, *PLACE]
    kinds = T.StructType([*rows.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("before", "after", "again")), T.StructField("edge", T.IntegerType()), T.StructField("range", T.IntegerType())])
    names, few = rows.columns, bool(inner)

    def run(batches):
        at, held, first = TaskContext.get().partitionId(), None, True

        def flagged(t: pa.Table, before, after, again, edge):
            keep = before | after | (edge > 0) if few else np.ones(len(before), bool)
            cols = [t.column(c).combine_chunks() for c in names] + [pa.array(x) for x in (before, after, again, edge.astype(np.int32), np.full(len(before), at, np.int32))]
            out = pa.Table.from_arrays(cols, names=kinds.names)
            return (out if keep.all() else out.filter(pa.array(keep))).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([b])])
            same = lambda cols: np.logical_and.reduce([(x := t.column(c).to_numpy())[1:] == x[:-1] for c in cols])
            equal, whole = same(keys), same([*keys, *inner])
            n = t.num_rows
            before, again = np.zeros(n, bool), np.zeros(n, bool)
            before[1:], again[1:] = equal, whole
            if held is not None:
                before[0], again[0] = held[1], held[2]
            edge = np.zeros(n, np.int64)
            edge[0] = int(first)
            if n > 1:
                yield from flagged(t.slice(0, n - 1), before[:-1], equal, again[:-1], edge[:-1])
                first = False
            held = t.slice(n - 1), before[-1], again[-1]
        if held is not None:
            one = lambda x: np.array([x])
            yield from flagged(held[0], one(held[1]), one(False), one(held[2]), one(2 + int(first)))

    out = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freeing(run), kinds))
    edges = out.where("edge > 0").select("range", "edge", *keys, *inner).collect()
    tops = sorted((e for e in edges if e["edge"] & 1), key=lambda e: e["range"])
    ends = {e["range"]: e for e in edges if e["edge"] & 2}
    follows, leads, repeats = [], [], []
    for above, e in zip(tops, tops[1:], strict=False):
        end = ends[above["range"]]
        if all(end[c] == e[c] for c in keys):
            follows.append(e["range"])
            leads.append(end["range"])
            if all(end[c] == e[c] for c in inner):
                repeats.append(e["range"])
    if follows:
        of = lambda bit, ranges: (F.col("edge").bitwiseAND(F.lit(bit)) > 0) & F.col("range").isin(ranges)
        out_path, out = out, out.withColumns({"before": F.col("before") | of(1, follows), "after": F.col("after") | of(2, leads), "again": F.col("again") | (of(1, repeats) if repeats else F.lit(False))})
        out._table_path = out_path._table_path
    found = (out.where("before or after") if few else out).drop("edge", "range")
    found._table_path = out._table_path
    return found


def windows(classes: DataFrame, least: int) -> DataFrame:
    """w1, w2, head, ctx, several, part and PLACE for each window of `least` words of the classes' texts (column piece).

    w1 and w2 are hashes of its words, part its place within the piece and span that in the whole text, as above."""
    kinds = "w1 long, w2 long, head long, ctx long, several boolean, part long, no_id boolean, doc_id long, file long, nth long, span long"

    def run(batches):
        for b in batches:
            for at, w in Words.parts(b.column("piece"), PART):
                starts = np.flatnonzero(w.ends_of() - np.arange(w.n) >= least)
                row = pa.array(at + w.text_of[starts])
                col = {c: b.column(c).take(row) for c in ("head", "ctx", "several", "no_id", "doc_id", "file", "nth", "span")}
                part = w.spans(starts, starts + least - 1)
                start = col["span"].to_numpy(zero_copy_only=False) >> 32
                made = {
                    "w1": run_hashes(w.sums(1), 1, starts, least).view(np.int64), "w2": run_hashes(w.sums(3), 3, starts, least).view(np.int64), "part": part, "span": part + (start << 32) + start,
                }
                cols = col | {k: pa.array(v) for k, v in made.items()}
                names = kinds.replace(",", "").split()[::2]
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return classes.mapInArrow(freeing(run), kinds)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans):
        a, b = s >> 32, s & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(row: np.ndarray, span: np.ndarray, rows: int) -> pa.ListArray:
    """The spans of each of the rows merged, as lists of (start, end)."""
    order = np.lexsort((span, row))
    row, span = row[order], span[order]
    start, end = span >> 32, span & 0xFFFFFFFF
    reach = np.maximum.accumulate((row << 33) + end) if len(row) else end
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] << 33) + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    until = reach[last] - (row[last] << 33) if len(first) else end
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))])
    pairs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(until.astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)


PAIRS = "array<struct<start:int,end:int>>"
FOUND = f"file long, nth long, doc_id long, repeats {PAIRS}, cuts {PAIRS}"


def located(docs: DataFrame, least: int) -> DataFrame:
    """FOUND for the rows of docs (file, nth, doc_id, text) that hold a repeated passage, as a table.

    Suffixes are sorted by their heads and then by the whole text of their windows. Those with equal texts are one
    class, with its first occurrence as its representative. A head with one class: all windows of its occurrences are
    repeated, or there is one occurrence and none is. A head with several classes: what they have in common depends on
    how far each match extends left and right, so the representatives' texts are read, and their windows sorted and
    compared in the same way; an occurrence repeats what its class does.
    """
    rows = cut(suffixes(docs, least))
    found = neighbours(rows, ["head"], ["ctx"])
    drop(rows)
    firsts = found.where("not again")
    several = found.where("again").select("head", "ctx").distinct().withColumn("several", F.lit(True))
    mixed = cut(firsts.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"))
    classes = firsts.select("head", "ctx", *PLACE).join(mixed, "head", "left_semi").join(several, ["head", "ctx"], "left")
    classes = cut(classes.withColumn("several", F.coalesce("several", F.lit(False))))
    start = F.shiftright("span", 32)
    size = F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)) - start
    reps = F.broadcast(classes) if classes.count() <= FEW else classes
    piece = F.substring("text", start + 1, size).alias("piece")
    held = windows(docs.select("file", "nth", "text").join(reps, ["file", "nth"]).select(*classes.columns, piece), least)
    near = neighbours(held, ["w1", "w2"], [])
    parts = near.where("before or after or several").groupBy("head", "ctx").agg(F.collect_list(F.struct("part", F.col("before").alias("cut"))).alias("parts"))
    known = cut(classes.select("head", "ctx").join(parts, ["head", "ctx"], "left").withColumn("mixed", F.lit(True)))
    drop(classes, mixed, near)
    whole = F.array(F.struct(F.col("span"), F.col("again").alias("cut")))
    moved = F.transform("parts", lambda x: F.struct((x["part"] + (start * F.lit(1 << 32)) + start).alias("span"), (F.col("again") | x["cut"]).alias("cut")))
    every = found.join(known, ["head", "ctx"], "left").select("file", "nth", "doc_id", F.when(F.col("mixed"), moved).otherwise(whole).alias("spans")).where(F.size("spans") > 0)
    lists = every.groupBy("file", "nth").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches):
        for b in batches:
            spans = b.column("spans")
            each = spans.flatten()
            row = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy())
            span, cuts = each.field("span").to_numpy(), each.field("cut").to_numpy(zero_copy_only=False)
            lists = [joined(row, span, b.num_rows), joined(row[cuts], span[cuts], b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("nth"), b.column("doc_id"), *lists], ["file", "nth", "doc_id", "repeats", "cuts"])

    out = cut(lists.mapInArrow(freeing(run), FOUND))
    drop(found, known)
    return out


#: Names of the keys of rows beside the columns of docs.
KEYS = ("__repeats_file", "__repeats_nth")


def keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(rows, id_col, text_col, *KEYS).withColumnsRenamed(dict(zip(KEYS, ("file", "nth"), strict=True)))


def repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, repeats, cuts of every row that holds a passage of `least` or more words found more than once.

    Any two equal passages of `least` words have the same minimiser, so the suffixes retained there have equal heads and
    meet as neighbours in sorted order; matches are then extended to all windows that stand on them (see located), and a
    longer passage is the union of its windows. repeats are all such passages, cuts those but the first of all (least
    doc_id, then the row's place in its files, then its own). No pair of occurrences is ever made, and rows of one key
    are spread over ranges: a passage that a third of all documents share is no task's list. Heads and texts of windows
    are compared by two independent 64-bit hashes, as are the windows' words.

    Rows are told apart by their file and place there, so rows that repeat an id or have none are rows of their own; of
    repeated rows the first keeps its passages. Null, empty and shorter texts have none; an empty table gives none.
    """
    return located(keyed(numbered(docs, *KEYS), id_col, text_col), least).drop("file", "nth")


def kept_text(text, cuts):
    """The text without the spans of cuts (sorted, apart)."""
    n = F.size(cuts)
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda x: x["end"]))
    ends = F.concat(F.transform(cuts, lambda x: x["start"]), F.array(F.char_length(text)))
    part = lambda i: F.substring(text, F.element_at(starts, i) + 1, F.greatest(F.lit(0), F.element_at(ends, i) - F.element_at(starts, i)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n + 1), part), ""))


def without_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from the text, but for the first of each; other columns stay as they are."""
    rows = numbered(docs, *KEYS)
    cuts = located(keyed(rows, id_col, text_col), least).where(F.size("cuts") > 0)
    cuts = cuts.select(F.col("file").alias(KEYS[0]), F.col("nth").alias(KEYS[1]), F.col("cuts").alias("__repeats_cuts"))
    joined = rows.join(cuts, list(KEYS), "left")
    return joined.withColumn(text_col, kept_text(F.col(text_col), F.col("__repeats_cuts"))).select(docs.columns)
