"""Exact ids and counts of public tokenizers, with a bounded memo of words.

Both tokenizers split a text into pieces that are encoded independently of each other, so that the encoding of a
text is that of its pieces one after the other; only pieces not seen lately are given to the library. Texts outside
the class of characters for which this split is simple go to the library whole.
"""

from __future__ import annotations

import array
import os
import re

from .common import Generations

#: Bytes that the words kept by a worker take at most, in each of two generations.
MEMO = 96 << 20
#: Characters that NFC leaves alone and whose lower case is one character: ASCII, and Latin-1 without its digits,
#: fractions and spaces. OTHER holds those of them that are neither letters, digits nor white space.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*").fullmatch
OTHER = r"[!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+"
PIECES = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|" + OTHER).findall
PIECES_QUOTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|" + OTHER).findall
RUNS = re.compile(r" +[^ ]+| +").findall


class WordBpe:
    """A tokenizers file with lower-casing and word ends (no token crosses white space)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, (x.content for x in self.t.get_added_tokens_decoder().values()))) or r"(?!)").search
        self.memo = Generations(self.whole, MEMO, lambda word, ids: len(word) + len(ids))

    def whole(self, text: str) -> bytes:
        return array.array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not SIMPLE(text) or self.special(text):
            return self.whole(text)
        low = text.lower()
        return b"".join(map(self.memo.__getitem__, (PIECES_QUOTE if "'" in low else PIECES)(low)))


class PieceBpe:
    """A sentencepiece BPE file; with no piece that has a space mark after another character, runs split at spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits = not any(re.search("[^▁]▁", self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()))
        self.memo = Generations(lambda w: len(self.sp.encode(w)), MEMO, lambda word, n: len(word))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits or "▁" in text:
            return len(self.sp.encode(text))
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.memo.__getitem__, text.split(" ")))
        return sum(self.memo[run[1:]] if run != " " else 1 for run in RUNS(" " + text))


class ByteBpe:
    """Any other tokenizers file: the library's own count, special strings as by its default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.t.encode(text, add_special_tokens=False).ids)


LOADED: dict = {}


def load(kind, path: str):
    """One tokenizer for each worker process."""
    if (kind, path) not in LOADED:
        LOADED[kind, path] = kind(path)
    return LOADED[kind, path]


def counter(path: str):
    return load(PieceBpe if path.endswith(".model") else ByteBpe, path)
