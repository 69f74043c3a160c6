"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freeing, texts

#: Training documents of a language at most, bytes taken of each, bytes of a text that are coded at once, and zstandard's level.
SAMPLE, PART, BLOCK, LEVEL = 160, 1024, 1024, 3
#: Places of a longer training text that its bytes are taken from.
PLACES = 8
#: Margin under which a prediction is rejected, and the letters that a text must have to show a margin at all.
NARROW, LETTERS = 0.004, 40
#: Runs of anything but letters count as one space, and case does not count.
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language, from at most SAMPLE labelled documents of each that are not held out.

    The documents of a language are taken by the least hash of their id: a first count of the labels gives the share of
    the hash's range that holds about 4 * SAMPLE of each, so no language's rows meet in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 40, 4 * SAMPLE * (1 << 40) // n)))))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= F.element_at(share, F.col("lang")))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "text"))).where(F.col("nth") <= SAMPLE)
    found: dict[str, list[bytes]] = {}
    for r in first.select("lang", "nth", "text").orderBy("lang", "nth").collect():
        found.setdefault(r["lang"], []).append(taken(normal(r["text"])))
    return {k: b"\n".join(found[k]) for k in sorted(found, key=lambda k: (-counts[k], k))}


def normal(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def taken(raw: bytes) -> bytes:
    """PART bytes at most: of a longer text, as many from a hashed place in each of PLACES equal stretches."""
    if len(raw) <= PART:
        return raw
    size, edges = PART // PLACES, [len(raw) * k // PLACES for k in range(PLACES + 1)]
    starts = (a + zlib.crc32(raw, k) % (b - a - size + 1) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return b"".join(raw[i : i + size] for i in starts)


class Coder:
    """Compressed sizes of a text, in blocks, with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.coders = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def __call__(self, text: str) -> tuple[str, float]:
        """The language of the smallest code (ties: the one with more training rows), and the margin: the share of the second code saved."""
        if not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0
        raw = normal(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(c(b)) for b in blocks), k) for k, c in enumerate(self.coders))
        return self.names[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0

    def rejects(self, text: str, name: str, margin: float) -> bool:
        """No letter, or a narrow margin in a text of LETTERS letters; in a shorter one, a narrow margin says nothing."""
        return name == "und" or margin < NARROW and sum(map(str.isalpha, text)) >= LETTERS


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: the language whose dictionary codes the whole text shortest.

    score is the margin to the second language as a share of its size; below NARROW in a text of at least LETTERS
    letters, and for texts without a letter (und, as null and empty ones), the prediction counts as rejected. Blocks keep a long text's own repetitions from
    hiding the dictionary. Repeated rows give repeated rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            whole = b.column("text").to_pylist()
            out = [coder(t) for t in whole]
            names, scores = [x for x, _ in out], [max(0.0, y) for _, y in out]
            no = [coder.rejects(t, x, y) for t, (x, y) in zip(whole, out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is not rejected, with their own columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    texts(docs.withColumn("doc_id", F.lit(0)) if "doc_id" not in docs.columns else docs)
    at = docs.columns.index(text_col)

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            keep = [not coder.rejects(t or "", *coder(t or "")) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)
