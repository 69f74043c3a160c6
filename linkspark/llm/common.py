"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch of texts.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without it, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder, and read again.

    A lost executor then costs no earlier stage, and the plan that follows starts from the table's own size and columns.
    Tables are removed by drop() once nothing reads them, and with the application's folder otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and that nothing will read again."""
    for t in tables:
        spark, path = t.sparkSession, t._table_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered(docs: DataFrame, file: str = "file", nth: str = "nth") -> DataFrame:
    """docs with a key for each row: a hash of its file's path and its place there.

    A table read from Parquet has them; anything else is written to the shared folder first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not parquet(docs):
        docs = cut(docs)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(nth))


def parquet(docs: DataFrame) -> bool:
    """Whether docs is a table of Parquet files as it was read, whose rows have an index."""
    from pyspark.errors import AnalysisException

    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keys: str) -> DataFrame:
    """Only the id, the text and the keys, null texts as empty ones: other columns, whatever their names, can't clash.

    Batches of texts for Python are held to BATCH rows, as a batch of whole texts must fit in a worker's memory.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, BATCH)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keys)


def freeing(run):
    """run(batches), after which the worker gives back the memory that its arrays no longer use: it lives on, idle, while
    other stages of the same executor run."""

    def through(batches):
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # a C library without it
            pass

    return through


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: Bytes of the objects that hold an entry of a memo.
OBJECTS = 360


class Generations(dict):
    """word -> value, made on first use, within two generations of at most `most` bytes each: what is used again while
    its generation is the older one moves to the younger, and the rest goes when that is full.

    size says the bytes of a word and its value beyond OBJECTS.
    """

    def __init__(self, make, most: int, size, longest: int = 64):
        super().__init__()
        self.make, self.most, self.size, self.longest, self.used, self.older = make, most, size, longest, 0, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.longest:
                return value
        self.keep(word, value)
        return value

    def keep(self, word, value) -> None:
        self.used += OBJECTS + self.size(word, value)
        if self.used > self.most:
            self.older = dict(self)
            self.clear()
            self.used = OBJECTS + self.size(word, value)
        self[word] = value


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat (of the given sizes, one after the other) that codes number, in their order; and where each
    begins in that, with the end of all."""
    starts = np.cumsum(sizes) - sizes
    taken = sizes[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
    return flat[np.repeat(starts[codes] - ends[:-1], taken) + np.arange(ends[-1])], ends


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; of fewer words, one of the whole sequence; of none, none."""
    n = min(k, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = mix(s * U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return s


#: Bytes of white space in ASCII, and the other white space of str.split in UTF-8.
SPACES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Odd numbers whose powers weigh the words of a run, and the words of which the powers are kept.
BASES = {1: 0x9E3779B97F4A7C15, 2: 0xD1342543DE82EF95, 3: 0xBF58476D1CE4E5B9}
KEPT = 1 << 18
POWERS: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and of its inverse."""
    if n <= KEPT:
        if base not in POWERS:
            POWERS[base] = powers(base, KEPT + 1)
        return tuple(x[:n] for x in POWERS[base])
    out = []
    for b in (BASES[base], pow(BASES[base], -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def run_hashes(sums: np.ndarray, base: int, start: np.ndarray, size) -> np.ndarray:
    """64-bit hashes of runs of words, from the weighted sums of all words before each."""
    return mix((sums[start + size] - sums[start]) * powers(base, len(sums))[1][start])


class Words:
    """The words (as str.split finds them) of several texts at once: hashes h, text_of (number of the text) and places."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        size = len(data)
        self.bounds = bounds
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        space = SPACES[data]
        for c in WIDE_SPACES:
            at = np.flatnonzero(data[: size - len(c) + 1] == c[0]) if size >= len(c) else np.zeros(0, np.int64)
            for k in range(1, len(c)):
                at = at[data[at + k] == c[k]]
            for k in range(len(c)):
                space[at + k] = True
        first, last = ~space, ~space
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        first[1:] &= space[:-1] | edge[1:size]
        last[:-1] &= space[1:] | edge[1:size]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.n = len(self.starts)
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(self.word_bounds))
        self.h = self.hashes(self.starts, self.ends - self.starts)

    @staticmethod
    def parts(column, size: int):
        """(number of the first text, Words) of consecutive texts of a string column, about `size` bytes at a time."""
        import pyarrow as pa

        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            yield i, Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j

    def hashes(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, eight bytes at a time; long ones by the library."""
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = mix((eight[at] & mask[np.minimum(size, 8)]) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        long = np.flatnonzero(size > 128)
        more, k = np.flatnonzero((size > 8) & (size <= 128)), 8
        while len(more):
            out[more] = mix(out[more] * U(0xD1342543DE82EF95) + (eight[at[more] + k] & mask[np.minimum(size[more] - k, 8)]))
            k += 8
            more = more[size[more] > k]
        for i in long.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[at[i] : at[i] + size[i]].tobytes())
        return out

    def ends_of(self) -> np.ndarray:
        """For each word, the number of the first word behind its text."""
        return self.word_bounds[1:][self.text_of]

    def sums(self, base: int) -> np.ndarray:
        """Weighted sums of all words before each; with base 2, of words with the white space behind them."""
        x = self.h
        if base == 2 and self.n > 1:
            gap = self.starts[1:] - self.ends[:-1]
            plain = (gap == 1) & (self.data[self.ends[:-1]] == 32)
            odd = np.flatnonzero(~plain)
            x = x.copy()
            x[odd] += mix(self.hashes(self.ends[odd], gap[odd]))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(base, self.n + 1)[0][: self.n], dtype=np.uint64)])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places in code points of runs of words (first and last) within their texts, start * 2**32 + end."""
        before = self.bounds[self.text_of[first]]
        start, end = self.starts[first], self.ends[last]
        if (self.data >= 0x80).any():
            chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((self.data & 0xC0) != 0x80)])
            before, start, end = chars[before], chars[start], chars[end]
        return (start - before << 32) | (end - before)
