"""MinHash near-duplicates: minima of universal hashes, banding, verification, and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, freeing, mix, numbered, shingle_hashes, texts, U, word_hashes
from .components import components

#: 32 bands of 5 minima: a link at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Classes up to this number (24 bytes each) are broadcast to pick their documents; beyond it, documents are shuffled.
FEW_IDS = 400_000
#: Hashed counters of the sets that hold a shingle: 8 MB on the driver and each executor. They only order shingles.
COUNTERS = 1 << 21
TABLE = "doc_id long, file long, nth long, set_key binary, n_shingles long, signature binary"
#: Names of the keys of rows beside the columns of docs.
KEYS = ("__near_file", "__near_nth")


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as a-z, ASCII white space ends a word."""
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower().split()), words))


def family(size: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, size, np.uint64) * U(2) + U(1), r.integers(0, 2**63, size, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each universal hash x -> (a x + b) >> 32, its least value on the set."""
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(s), 128):
        np.minimum(out, (s[at : at + 128, None] * a[None, :] + b[None, :]).min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)


def signed(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, file, nth, set_key (a digest of the whole set; null for an empty one), n_shingles, signature of every text."""

    def run(batches):
        a, b = family(bands * rows)
        seen: dict = {}
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for t in batch.column("text").to_pylist():
                d = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                if d not in seen:
                    if len(seen) >= 2000:
                        seen.clear()
                    s = shingle_set(t, words)
                    seen[d] = (xxhash.xxh3_128_digest(s.tobytes()), len(s), minima(s, a, b).tobytes()) if len(s) else (None, 0, None)
                for x, y in zip((keys, sizes, signatures), seen[d], strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "nth")), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], TABLE.replace(",", "").split()[::2])

    return docs.mapInArrow(freeing(run), TABLE)


def band_keys(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, rid: a 64-bit key for each band of each signature."""

    def run(batches):
        powers = mix(np.arange(1, rows + 1, dtype=np.uint64))
        salt = mix(np.arange(bands, dtype=np.uint64) + U(1 << 40))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, bands, rows)
                keys = mix(mix((mix(sig.astype(np.uint64) + U(1)) * powers[None, None, :]).sum(axis=2, dtype=np.uint64)) + salt[None, :])
                ids = np.repeat(part.column("rid").to_numpy(zero_copy_only=False).astype(np.int64), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "rid"])

    return reps.select("rid", "signature").mapInArrow(run, "key long, rid long")


def sets_of(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """rid, shingles: the full shingle sets of the classes in reps (rid, file, nth), read from their first rows; a counted,
    bounded number of classes is broadcast."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["rid", "shingles"])

    few = F.broadcast(reps) if reps.count() <= FEW_IDS else reps
    return docs.join(few, ["file", "nth"]).select("rid", "text").mapInArrow(freeing(run), "rid long, shingles binary")


@F.pandas_udf(T.DoubleType())
def agreement(a, b):
    """Share of equal minima."""
    import pandas as pd

    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


@F.pandas_udf(T.LongType())
def common(a, b):
    """Size of the intersection of two sorted sets of 64-bit hashes."""
    import pandas as pd

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        at = np.searchsorted(y, x)
        out.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
    return pd.Series(out, dtype="int64")


def holders(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold each shingle, in COUNTERS hashed counters: a bounded table, whatever the sets hold."""

    def run(batches):
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column("shingles").to_pylist():
                np.add.at(n, counter(np.frombuffer(s, U)), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    found = sets.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int32)
    out[found.column("at").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return out


def counter(s: np.ndarray) -> np.ndarray:
    return (s % U(COUNTERS)).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """rid, shingle, place, n: the places of each set, rarest shingles first, of which a linked set shares one at least.

    A shingle whose counter is 1 is in one set only; it keeps its place but is not returned.
    """
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), [[], [], [], []]
                for rid, raw in zip(part.column("rid").to_pylist(), part.column("shingles").to_pylist(), strict=True):
                    s = np.frombuffer(raw, U)
                    n, seen = len(s), held.value[counter(s)]
                    first = np.lexsort((s, seen))[: n + 1 - -(-percent * n // 100)]
                    place = np.flatnonzero(seen[first] > 1)
                    for x, y in zip(out, (np.full(len(place), rid), s[first[place]].view(np.int64), place, np.full(len(place), n)), strict=True):
                        x.append(y.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["rid", "shingle", "place", "n"])

    return sets.mapInArrow(run, "rid long, shingle long, place long, n long")


def across(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs in different components (labels: rid, component) that can be linked, by their sets.

    In one order of all shingles, a linked pair's first common shingle stands early enough in both sets that what follows
    can hold the intersection it needs. Pairs meet at such shingles only. Near copies of one text which are no links of
    each other have more rare shingles than that, so they don't meet at those that all of them hold.
    """
    sets = sets.join(labels.select("rid"), "rid", "left_semi")
    rows = cut(prefixes(sets, holders(sets), percent).join(labels, "rid"))
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    x = cut(rows.join(mixed, "shingle", "left_semi"))
    y = x.select(*(F.col(c).alias(f"{c}_b") for c in x.columns))
    fits = f"rid > rid_b and component <> component_b and 100 * least(n, n_b) >= {percent} * greatest(n, n_b) and {100 + percent} * least(n - place, n_b - place_b) >= {percent} * (n + n_b)"
    out = cut(x.join(y, (F.col("shingle") == F.col("shingle_b")) & F.expr(fits)).select(F.col("rid").alias("a"), F.col("rid_b").alias("b")).distinct())
    drop(rows, x)
    return out


def likely_share(percent: int, size: int) -> float:
    """The share of equal minima that a link falls short of with probability 3e-7: 5 standard deviations less than its mean."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / size) ** 0.5


class Verifier:
    """Confirms pairs, first by their signatures, then on their full sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, members: DataFrame, words: int, percent: int, size: int):
        self.percent, self.size, ids = percent, size, members.select("rid").distinct()
        self.reps = cut(reps.join(ids, "rid", "left_semi"))
        self.signatures = self.reps.select("rid", "n_shingles", "signature")
        self.docs, self.words, self.sets = docs, words, None

    def both(self, pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("rid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
        return pairs

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow a link and whose minima agree as a link's do."""
        x = self.both(pairs, self.signatures, "n_shingles", "signature")
        x = x.where(100 * F.least("n_shingles_a", "n_shingles_b") >= self.percent * F.greatest("n_shingles_a", "n_shingles_b"))
        return x.where(agreement("signature_a", "signature_b") >= likely_share(self.percent, self.size)).select("a", "b", F.col("n_shingles_a").alias("n_a"), F.col("n_shingles_b").alias("n_b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        likely = cut(self.likely(pairs))
        if self.sets is None:
            self.sets = cut(sets_of(self.docs, self.reps.select("rid", "file", "nth"), self.words))
        x = self.both(likely, self.sets, "shingles").withColumn("both", common("shingles_a", "shingles_b"))
        out = cut(x.where(100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))
        drop(likely)
        return out


def grouped(base: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, file, nth, n_shingles and first for every row of base (doc_id, file, nth, text).

    first (no_id, doc_id, file, nth) is the first row of its component: those without an id come last, those that repeat
    an id by their place in the files. Nodes of the components are classes of equal sets, numbered once in a table.
    """
    table = cut(signed(base, words, bands, rows))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "nth")
    classes = table.where("set_key is not null").groupBy("set_key").agg(F.min(own).alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    reps = cut(classes.select("set_key", "own", "own.file", "own.nth", "n_shingles", "signature", F.monotonically_increasing_id().alias("rid")))
    keys = band_keys(reps, bands, rows)
    rank = lambda t: F.struct(F.xxhash64(F.lit(t), "rid").alias("rank"), F.col("rid"))
    hubs = cut(keys.groupBy("key").agg(F.min(rank(1)).getField("rid").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = cut(keys.join(hubs, "key"))
    ordered = lambda d, x, y: d.where(f"{x} <> {y}").select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    verify = Verifier(base, reps, members, words, percent, bands * rows)
    pairs = cut(ordered(members, "hub", "rid"))
    links = verify.links(pairs)
    found = components(links)

    def labelled() -> DataFrame:
        """Members of buckets of over two that hold several components, with theirs."""
        x = cut(members.where("size > 2").select("key", "rid", "size").join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")))
        several = cut(x.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
        x, whole = cut(x.join(several, "key", "left_semi")), x
        central = F.struct(F.col("weight"), rank(2).alias("at"))
        weights = x.groupBy("rid").agg(F.sum("size").alias("weight"))
        mixed = cut(x.select("key", "rid").join(weights, "rid").groupBy("key").agg(F.max(central).getField("at").getField("rid").alias("hub")))
        drop(several, whole)
        out = cut(x.join(mixed, "key"))
        drop(x, mixed)
        return out

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        out = cut(x.union(y))
        drop(x, y)
        return out

    mixed = labelled()
    second = cut(ordered(mixed, "hub", "rid").join(pairs, ["a", "b"], "left_anti"))
    if second.take(1):
        links = joined(links, verify.links(second))
        drop(found)
        found = components(links)
    drop(mixed)
    mixed = labelled()
    if mixed.take(1):
        labels = cut(mixed.select("rid", "component").distinct())
        met = across(verify.sets, labels, percent)
        third = cut(met.join(pairs, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"))
        drop(labels, met)
        if third.take(1):
            links = joined(links, verify.links(third))
            drop(found)
            found = components(links)
        drop(third)
    drop(hubs, members, pairs, second, mixed, links, verify.reps, verify.sets)
    classes = reps.select("set_key", "own", "rid").join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    classes = cut(classes)
    firsts = classes.groupBy("component").agg(F.min("own").alias("first"))
    classes, whole = cut(classes.select("set_key", "component").join(firsts, "component").select("set_key", "first")), classes
    drop(reps, found, whole)
    return table.select("doc_id", "file", "nth", "set_key", "n_shingles").join(classes, "set_key", "left").drop("set_key")


def keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(rows, id_col, text_col, *KEYS).withColumnsRenamed(dict(zip(KEYS, ("file", "nth"), strict=True)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts with equal shingle sets are one class; from there on only classes count. Classes that share a band are
    candidates. Within a band's bucket not all pairs are made: all members are compared
    with one hub, picked by a hash, and then, in buckets that still hold several components, with the member whose
    buckets are the largest, which of near copies is the one most like the others. Members of buckets which even then
    hold several components meet at the rare shingles of their full sets (see across), where any link between two
    components is found. A pair within one component adds nothing, so no link between components is lost, whatever a
    bucket's size. Pairs are verified on signatures and then on full sets.

    component_id is the smallest id of a component's rows. Null and empty texts, and texts of white space, have an empty
    set and are linked with nothing. Rows that repeat an id are classed by their own text. Rows with a null id are linked
    by their text, and have a null component where no row in it has an id; kept is doc_id = component_id, nulls being
    equal. An empty table gives none.
    """
    found = grouped(keyed(numbered(docs, *KEYS), id_col, text_col), words, percent, bands, rows)
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the first by id and then by place in the files; rows with nothing in
    their set all stay, as do all columns."""
    numbers = numbered(docs, *KEYS)
    found = grouped(keyed(numbers, id_col, text_col), words, percent, BANDS, ROWS)
    gone = found.where("first is not null and not (file <=> first.file and nth <=> first.nth)")
    return numbers.join(cut(gone.select(F.col("file").alias(KEYS[0]), F.col("nth").alias(KEYS[1]))), list(KEYS), "left_anti").select(docs.columns)
