"""N-best segmentation into the pieces of a sentencepiece file, and decoding."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import OBJECTS, Generations, U, freeing, gathered, mix, texts
from .tokenizing import load

MARK = "▁"
#: Letters, or other characters (Latin-1's raised digits and fractions too), with the marks before them. Files whose
#: pieces are one run each allow cuts between runs; others are segmented whole.
RAISED = "\xb2\xb3\xb9\xbc-\xbe"
RUN = re.compile(f"{MARK}*[^\\W\\d_{RAISED}]+|{MARK}*(?:[^\\w{MARK}]|[\\d_{RAISED}])+|{MARK}+").findall


#: Characters of the texts whose new runs are segmented together, and runs of one length at once.
TOGETHER, TOGETHER_RUNS = 1 << 21, 2048
#: Bytes that the runs kept by a worker take at most, in each of two generations.
MEMO = 8 << 20


#: Longest runs, and least number of one length, that are segmented together; base of the hashes of substrings.
WIDE, FEW, BASE = 24, 16, 0x9E3779B97F4A7C15


def exact(score: float) -> float:
    return round(score * 2**20) / 2**20


def substring_keys(strings: list[str]) -> np.ndarray:
    """Hashes of strings' code points, as those of a run's substrings are made."""
    out = np.zeros(len(strings), U)
    for k, s in enumerate(strings):
        h = 0
        for c in s:
            h = (h * BASE + ord(c)) % 2**64
        out[k] = (h + len(s)) % 2**64
    return mix(out)


class Lattice:
    """The pieces of a file with scores of a unigram model: its BPE files hold ranks only, so a piece of rank r scores
    -log(r + 2), as under Zipf's law, and a byte of a character that is no piece -2 log(number of pieces), both rounded
    to multiples of 2**-20, so that sums are exact in any order."""

    def __init__(self, path: str, best: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.best = sp.get_piece_size(), best
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (exact(-math.log(r + 2)), (i,)) for r, i in enumerate(plain)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = {i: p.encode() for p, (_, (i,)) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        texts_of = [self.text.get(i, b"") for i in range(n)]
        self.piece_bytes, self.piece_sizes = np.frombuffer(b"".join(texts_of), np.uint8), np.array(list(map(len, texts_of)), np.int64)
        self.byte_score = exact(-2 * math.log(n))
        self.splits = all(len(RUN(p)) == 1 for p in self.pieces)
        self.trie: dict = {}  # character -> [the same for what follows, score and ids of the piece that ends here]
        for p, (x, ids) in self.pieces.items():
            kids = self.trie
            for c in p[:-1]:
                kids = kids.setdefault(c, [{}, 0.0, None])[0]
            kids.setdefault(p[-1], [{}, 0.0, None])[1:] = x, ids
        self.longest = max(map(len, self.pieces), default=0)
        keys = substring_keys(list(self.pieces))
        order = np.argsort(keys)
        self.keys, found = keys[order], list(self.pieces.values())
        self.key_ids, self.key_scores = np.array([x[1][0] for x in found], np.uint32)[order], np.array([x[0] for x in found])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> U(44)] = True
        self.memo = Generations(self.brief, MEMO, lambda run, value: 2 * len(run) + len(value[0]))
        self.others = Generations(lambda run: self.nbest(run, best), MEMO, lambda run, ways: 2 * len(run) + best * OBJECTS + sum(8 * len(ids) for _, ids in ways))

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end, the pieces that end there: (start, score, ids)."""
        return self.lattice(s)[0]

    def lattice(self, s: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """The edges, and the best score of every beginning."""
        n, trie = len(s), self.trie
        into: list[list] = [[] for _ in range(n + 1)]
        front = [0.0] + [-math.inf] * n
        for i, c in enumerate(s):
            at, j, before = trie.get(c), i + 1, front[i]
            if at is None or at[2] is None:
                raw = c.encode("utf-8", "surrogatepass")
                x = self.byte_score * len(raw)
                into[j].append((i, x, tuple(self.bytes[b] for b in raw)))
                front[j] = max(front[j], before + x)
            while at is not None:
                kids, x, ids = at
                if ids is not None:
                    into[j].append((i, x, ids))
                    if before + x > front[j]:
                        front[j] = before + x
                if j == n or not kids:
                    break
                at = kids.get(s[j])
                j += 1
        return into, front

    def brief(self, s: str) -> tuple[bytes, float, float]:
        """The ids and score of a run's best segmentation, and what its second best loses."""
        found = self.nbest(s, 2)
        return array("I", found[0][1]).tobytes(), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else math.inf

    def briefs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What brief would make of many runs: their order here, and in it the scores, losses, numbers of ids, and ids.

        One forward pass with the two best scores of every beginning handles all runs of one length at once. Runs with a
        character that is no piece are left to brief, as are long ones and lengths that few have.
        """
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        done, odd = [], [np.flatnonzero(sizes > WIDE)]
        for n in np.unique(sizes[sizes <= WIDE]).tolist():
            same = np.flatnonzero(sizes == n)
            for at in range(0, len(same), TOGETHER_RUNS):
                some = same[at : at + TOGETHER_RUNS]
                if len(some) < FEW:
                    odd.append(some)
                    continue
                whole, *made = self.briefs_of_length([runs[i] for i in some.tolist()], n)
                done.append((some[whole], *made))
                odd.append(some[~whole])
        odd = np.concatenate(odd)
        found = [self.memo[runs[i]] for i in odd.tolist()]
        ids = np.frombuffer(b"".join(x[0] for x in found), np.uint32)
        done.append((odd, np.array([x[1] for x in found], float), np.array([x[2] for x in found], float), np.array([len(x[0]) // 4 for x in found], np.int64), ids))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def briefs_of_length(self, runs: list[str], n: int):
        """Which of the runs have pieces for all characters, and of those the scores, losses, numbers of ids, and ids."""
        codes = np.array(runs, f"<U{n}").view(np.uint32).reshape(-1, n).astype(U)
        longest = min(n, self.longest)
        scores, ids, h = {}, {}, np.zeros((len(runs), n + 1), U)
        for size in range(1, longest + 1):
            h = h[:, : n - size + 1] * U(BASE) + codes[:, size - 1 :]
            keys = mix(h + U(size))
            at = np.flatnonzero(self.maybe[keys >> U(44)])
            wanted = keys.ravel()[at]
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            good = self.keys[found] == wanted
            at, found = at[good], found[good]
            x, y = np.full(keys.size, -np.inf), np.zeros(keys.size, np.uint32)
            x[at], y[at] = self.key_scores[found], self.key_ids[found]
            scores[size], ids[size] = np.ascontiguousarray(x.reshape(keys.shape).T), y.reshape(keys.shape)
        whole = (scores[1] > -np.inf).all(axis=0)
        first, second = np.zeros((n + 1, len(runs))), np.full((n + 1, len(runs)), -np.inf)
        back = np.zeros((n + 1, len(runs)), np.int64)
        for j in range(1, n + 1):
            best, other, size_of = first[j], second[j], back[j]
            best[:] = -np.inf
            for size in range(min(j, longest), 0, -1):  # of equal ways the one with the longest last piece
                x = scores[size][j - size]
                one = first[j - size] + x
                better = one > best
                np.maximum(other, np.where(better, np.maximum(best, second[j - size] + x), one), out=other)
                np.copyto(best, one, where=better)
                size_of[better] = size
        at, path, count = np.where(whole, n, 0), np.zeros((len(runs), n), np.uint32), np.zeros(len(runs), np.int64)
        while len(go := np.flatnonzero(at)):
            size = back[at[go], go]
            for k in np.unique(size).tolist():
                mine = go[size == k]
                count[mine] += 1
                path[mine, n - count[mine]] = ids[k][mine, at[mine] - k]
                at[mine] -= k
        used = np.arange(n)[None, :] >= n - count[:, None]
        return whole, first[n][whole], first[n][whole] - second[n][whole], count[whole], path[used & whole[:, None]]

    def nbest(self, s: str, best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a run, best first, ties to the way that is nearer the start.

        Forward Viterbi gives the exact best score of every beginning; A-star goes from the end backward, where the
        score so far plus that of the beginning left is exactly what the best way on will reach.
        """
        into, front = self.lattice(s)
        push, pop = heapq.heappush, heapq.heappop
        heap, out, seen, made = [(-front[-1], len(s), 0, 0.0, ())], [], [0] * (len(s) + 1), 0
        while heap and len(out) < best:
            _, j, _, so_far, tail = pop(heap)
            if not j:
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((so_far, tuple(ids)))
                continue
            if seen[j] == best:  # no more than the `best` best ways from here to the end can count
                continue
            seen[j] += 1
            ends = into[j]
            if len(ends) > best:  # nor more than the `best` best pieces that end here
                ends = sorted(ends, key=lambda e: (-(e[1] + front[e[0]]), e[0]))[: best + 1]
            for i, x, ids in ends:
                made += 1
                push(heap, (-(so_far + x + front[i]), i, made, so_far + x, (ids, tail)))
        return out

    def runs(self, text: str) -> list[str]:
        """The text with space marks, and one before it, cut where no piece can cross."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return RUN(marked) if self.splits else [marked]

    def parts(self, whole: list[str]):
        """Lists of (text, runs) of about TOGETHER characters each."""
        out, size = [], 0
        for t in whole:
            out.append((t, self.runs(t)))
            size += len(t)
            if size >= TOGETHER:
                yield out
                out, size = [], 0
        if out:
            yield out

    def rows(self, part: list[tuple[str, list[str]]]) -> list[tuple]:
        """For each text of a part: number of pieces, score and CRC-32 of the best segmentation, the scores of the `best`
        best, and whether the best decodes to the text. Each distinct run is looked up once; the rest are array operations."""
        sizes = np.array([len(runs) for _, runs in part])
        coded = pa.array(list(chain.from_iterable(runs for _, runs in part)), pa.string()).dictionary_encode()
        order, scores, losses, counts, flat = self.briefs(coded.dictionary.to_pylist())
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        ids, ends = gathered(flat, counts, codes)
        raw, byte_ends = gathered(self.piece_bytes, self.piece_sizes, ids)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        id_bounds = ends[bounds]
        byte_bounds = byte_ends[id_bounds]
        sums, all_losses, out = np.concatenate([[0.0], np.cumsum(scores[codes])]), losses[codes], []
        for k, (t, runs) in enumerate(part):
            a, b = bounds[k], bounds[k + 1]
            mine = ids[id_bounds[k] : id_bounds[k + 1]]
            back = raw[byte_bounds[k] : byte_bounds[k + 1]].tobytes().decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]
            top = float(sums[b] - sums[a])
            out.append((len(mine), top, zlib.crc32(mine.tobytes()), [top - x for x, _ in self.ways(runs, all_losses[a:b])], back == t.replace(MARK, " ")))
        return out

    def ways(self, runs: list[str], losses: np.ndarray) -> list[tuple[float, tuple]]:
        """What the best segmentations of a text lose, and the runs that they change: its runs' segmentations, least sums
        of losses first.

        Runs are independent, so a sum's next best differs in few runs; with the first losses sorted, only the
        `best` - 1 runs that lose least can change in the first `best` sums.
        """
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        few = min(self.best - 1, len(losses))
        if not few:
            return sums
        at = np.flatnonzero(losses <= np.partition(losses, few - 1)[few - 1])
        for k in at[np.argsort(losses[at], kind="stable")][:few].tolist():
            if losses[k] < math.inf:
                other = self.others[runs[k]]
                more = [(lost + other[0][0] - y[0], (*ways, (k, y[1]))) for lost, ways in sums for y in other[1:]]
                sums = heapq.nsmallest(self.best, sums + more, key=lambda x: x[0])
        return sums

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """(score, ids) of the best segmentations of a whole text, best first."""
        runs = self.runs(text)
        found = list(map(self.memo.__getitem__, runs))
        if not found:
            return [(0.0, b"")]
        ids, scores, losses = zip(*found, strict=True)
        top, out = sum(scores), []
        for lost, ways in self.ways(runs, np.array(losses, float)):
            mine = list(ids)
            for k, other in ways:
                mine[k] = array("I", other).tobytes()
            out.append((top - lost, b"".join(mine)))
        return out

    def decode(self, ids) -> str:
        """The text of ids; of the marks the first is dropped and the others are spaces."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


FIELDS = "doc_id long, n_pieces long, score double, ids_crc32 long, scores array<double>, round_trip boolean"


def segment(docs: DataFrame, model_path: str, best: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, score, ids_crc32 of the best segmentation, the scores of the `best` best, and whether the
    best decodes to the text (space marks in it count as spaces).

    Null and empty texts have no pieces and one segmentation of score 0; repeated rows give repeated rows; an empty
    table gives none. Whole texts are segmented, run by run; lately seen runs come from a bounded memo.
    """

    def run(batches):
        x = load(Best[best], model_path)
        for b in batches:
            rows = []
            for part in x.parts(b.column("text").to_pylist()):
                rows.extend(x.rows(part))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], FIELDS.replace(",", "").split()[::2])

    return texts(docs, id_col, text_col).mapInArrow(freeing(run), FIELDS)


class Kinds(dict):
    def __missing__(self, best):
        self[best] = lambda path: Lattice(path, best)
        return self[best]


Best = Kinds()
