"""Secret scans: fixed patterns, and strings that a character Markov model calls random. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Strings that are scored, and characters that the models know; any other is the class "other".
STRING = "[A-Za-z0-9+/_=-]{16,}"
KNOWN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(KNOWN) + 2
#: Digests, and words, that the labelled samples are made of, at most; log-likelihood ratio (nats) a character, from which on a string is random.
SAMPLE, THRESHOLD = 2_000, 0.9
#: Least characters of a scored string, and those beside which its parts may begin and end: the last ones of KNOWN.
LEAST, EDGES = 16, "+/_=-"
KINDS = ("assign", "access", "hex", "random")


def symbols(text):
    """Codes 1 to SIZE - 1 of the characters; 0 stands before the first."""
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(KNOWN), c), F.lit(0)), F.lit(SIZE - 1)))


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """Labelled samples of random strings: the digests of 0 to n - 1 as hexadecimal, base64 and upper-case text."""
    d = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    wide = F.translate(F.base64(F.unhex("h")), "=", "")
    forms = F.array(F.substring("h", 1, 32), F.substring(wide, 1, 40), F.upper(F.substring(F.translate(wide, "+/", ""), 1, 24)), F.substring(F.translate(wide, "+/", "-_"), 5, 24))
    return d.select(F.explode(forms).alias("string"), F.lit(1).alias("secret"))


def ordinary_strings(texts: DataFrame, n: int) -> DataFrame:
    """Labelled samples of ordinary identifiers: distinct words of prose (column text), alone and joined as names are.

    With letters they hold the usual short numbers of names; the n of least hash are taken. Lines and fillings of one
    character are ordinary as well, for each word one of a character picked by its hash.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct()
    words = words.orderBy(F.xxhash64("w"), "w").limit(n)
    w, small = F.col("w"), F.lower("w")
    num = F.pmod(F.xxhash64(F.lit(7), "w"), F.lit(40)).cast("string")
    forms = F.array(w, F.concat(small, small), F.concat_ws("_", small, small, num), F.concat(small, F.initcap(small)), F.concat_ws("-", small, F.upper(w), F.lit("2024-01")), F.upper(w), F.concat_ws("/", small, small, F.concat(F.lit("v"), num)))
    forms = F.concat(forms, F.array(F.concat(small, small, small), F.concat(w, F.initcap(small), F.initcap(small)), F.repeat(F.substring(F.lit(KNOWN), F.pmod(F.xxhash64(F.lit(8), "w"), F.lit(len(KNOWN))).cast("int") + 1, F.lit(1)), F.lit(40))))
    return words.select(F.explode(forms).alias("string"), F.lit(0).alias("secret"))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratio of each transition (index previous * SIZE + next) from strings labelled secret 1 or 0.

    Two first-order models with half a count added for every transition. The counts are at most SIZE squared rows for
    each label, whatever the sample.
    """
    s = labelled.select("secret", F.concat(F.array(F.lit(0)), symbols("string")).alias("s"))
    moves = s.select("secret", F.explode(F.transform(F.sequence(F.lit(2), F.size("s")), lambda i: F.element_at("s", i - 1) * SIZE + F.element_at("s", i))).alias("move"))
    n = {(r["secret"], r["move"]): r["n"] for r in moves.groupBy("secret", "move").agg(F.count(F.lit(1)).alias("n")).collect()}

    def log(label: int, before: int) -> list[float]:
        row = [n.get((label, before * SIZE + c), 0) + 0.5 for c in range(SIZE)]
        return [math.log(v / sum(row)) for v in row]

    return [x - y for p in range(SIZE) for x, y in zip(log(1, p), log(0, p), strict=True)], THRESHOLD


def scan(docs: DataFrame, model: tuple[list[float], float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, text and spans (start, kind number, end) of every row, in order of start and kind.

    Matches of a pattern are taken with the pieces of text between them, whose lengths add up to their places. Strings
    of 16 or more characters that overlap no other span are scored by the models' ratio; those
    above the threshold are spans of the kind random. Of the others, the parts between separators that reach it are, as
    a path or a name before a random string must not hide it. Null texts count as empty and have no spans; repeated rows give
    repeated rows; an empty table gives none. With `keep`, the result has those columns of docs and __spans instead.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    own_row = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    rest = ["row"] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"), *own_row)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": STRING}
    rows = rows.select("doc_id", "text", *rest, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_m") for k, p in patterns.items()))
    gaps = {f"{k}_g": F.when(F.size(f"{k}_m") > 0, F.transform(F.split("text", p, -1), lambda x: F.char_length(x))) for k, p in patterns.items()}
    values = F.when(F.size("assign_m") > 0, F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda x: F.char_length(x)))
    rows = rows.withColumns(gaps | {"assign_v": values})
    kind = {k: i for i, k in enumerate(KINDS)}

    def ends(k):
        """0, and the places where the matches end: running sums of the lengths of pieces and matches."""
        step = lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(F.col(f"{k}_g"), i) + F.char_length(F.element_at(F.col(f"{k}_m"), i))))
        return F.when(F.size(f"{k}_m") > 0, F.aggregate(F.sequence(F.lit(1), F.size(f"{k}_m")), F.array(F.lit(0)), step))

    def places(k):
        """(start, kind, end, number of the match)."""
        at = lambda i: F.element_at(F.col(f"{k}_e"), i)
        one = lambda i: F.struct((at(i) + F.element_at(F.col(f"{k}_g"), i)).alias("start"), F.lit(kind[k]).alias("kind"), at(i + 1).alias("end"), i.alias("i"))
        none = F.expr("array()").cast("array<struct<start:int,kind:int,end:int,i:int>>")
        return F.when(F.size(f"{k}_m") > 0, F.transform(F.sequence(F.lit(1), F.size(f"{k}_m")), one)).otherwise(none)

    rows = rows.withColumns({f"{k}_e": ends(k) for k in KINDS})
    rows = rows.withColumns({f"{k}_p": places(k) for k in KINDS})
    rows = rows.withColumn("assign_p", F.filter("assign_p", lambda x: F.element_at("assign_v", x["i"]) >= 6))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign_p", "access_p", "hex_p")))
    # one constant that Spark folds, and once in the plan: what uses it gets it as a variable (see randoms)
    table = F.split(F.lit(",".join(map(repr, map(float, model[0])))), ",").cast("array<double>")

    def score(s, ratio):
        codes = F.concat(F.array(F.lit(0)), symbols(s))
        return F.aggregate(F.sequence(F.lit(2), F.size(codes)), F.lit(0.0), lambda acc, i: acc + F.element_at(ratio, F.element_at(codes, i - 1) * SIZE + F.element_at(codes, i) + 1)) / F.char_length(s)

    state = "struct<sum:double,late:double,low:double,start:int,base:double,best:double,out:array<struct<start:int,end:int>>>"

    def parts(s, ratio):
        """(start, end) of disjoint parts of s, from edge to edge and of LEAST or more characters, of which the mean
        ratio reaches the threshold: in order, one for every place where such a part ends that no part before holds.

        One pass: sum is that of ratios less threshold, late the same LEAST characters before. low is the least late at
        an edge (as if the string began there), so a part ends at an edge where sum is low or more. It grows to later
        edges while its own sum (sum less base) does; the next one begins behind it.
        """
        codes = F.concat(F.array(F.lit(0)), symbols(s))
        move = lambda x, y: F.element_at(ratio, x * SIZE + y + 1)
        edge = lambda c: c.between(len(KNOWN) - len(EDGES) + 1, len(KNOWN))

        def scanned(c):
            n = F.size(c) - 1
            code = lambda i: F.element_at(c, F.greatest(i, F.lit(0)) + 1)

            def step(acc, j):
                i = j - LEAST  # characters before a part of LEAST characters that ends here
                total = acc["sum"] + move(code(j - 1), code(j)) - model[1]
                late = F.when(i > 0, acc["late"] + move(code(i - 1), code(i)) - model[1]).otherwise(F.lit(0.0))
                at = late + move(code(i), code(i + 1)) - move(F.lit(0), code(i + 1))
                behind = F.coalesce(F.get(acc["out"], F.size(acc["out"]) - 1)["end"], F.lit(0))
                lower = (i >= behind) & ((i == 0) | edge(code(i))) & (at < acc["low"])
                low, start = F.when(lower, at).otherwise(acc["low"]), F.when(lower, i).otherwise(acc["start"])
                ends = (j == n) | edge(code(F.least(j + 1, n)))
                grows = ends & (F.size(acc["out"]) > 0) & (total - acc["base"] > acc["best"])
                new = ends & ~grows & (total >= low)
                last = F.get(acc["out"], F.size(acc["out"]) - 1)
                out = F.when(grows, F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), j.alias("end")))))
                out = out.when(new, F.concat(acc["out"], F.array(F.struct(start.alias("start"), j.alias("end"))))).otherwise(acc["out"])
                base = F.when(new, low).otherwise(acc["base"])
                best = F.when(grows | new, total - base).otherwise(acc["best"])
                low = F.when(grows | new, F.lit(math.inf)).otherwise(low)
                return F.struct(*(v.alias(k) for k, v in {"sum": total, "late": late, "low": low, "start": start, "base": base, "best": best, "out": out}.items())).cast(state)

            none = F.struct(F.lit(0.0), F.lit(0.0), F.lit(math.inf), F.lit(0), F.lit(0.0), F.lit(0.0), F.array()).cast(state)
            return F.aggregate(F.sequence(F.lit(1), n), none, step, lambda acc: acc["out"])

        return F.element_at(F.transform(F.array(codes), scanned), 1)

    own = lambda x: F.element_at(F.col("random_m"), x["i"])
    free = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))

    def randoms(ratio):
        moved = lambda x: F.transform(parts(own(x), ratio), lambda y: F.struct((x["start"] + y["start"]).alias("start"), x["kind"].alias("kind"), (x["start"] + y["end"]).alias("end"), x["i"].alias("i")))
        found = lambda x: F.when(free(x) & (score(own(x), ratio) >= model[1]), F.array(x)).when(own(x).rlike(f"[{EDGES}]"), F.filter(moved(x), free)).otherwise(F.slice(F.array(x), 1, 0))
        return F.flatten(F.transform("random_p", found))

    rows = rows.withColumn("random_p", F.element_at(F.transform(F.array(table), randoms), 1))
    spans = F.array_sort(F.concat("base", "random_p"))
    return rows.select("row.*", spans.alias("__spans")) if keep else rows.select("doc_id", "text", "base", spans.alias("spans"))


def listed(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    n = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("base", "assign"), n("base", "access"), n("base", "hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n("spans", "random"))


def masked(text, spans, mask: str = "[SECRET]"):
    """The text with every run of overlapping spans replaced by the mask."""
    one = "struct<at:int,out:string>"
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(one),
        lambda acc, x: F.when(
            x["end"] > acc["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))).alias("out"),
            ).cast(one),
        ).otherwise(acc),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))
