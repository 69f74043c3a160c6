"""Ids by words and a memo against the library's of whole texts."""

import numpy as np
import pytest

from linkspark.llm import tokenizing

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_ids_of_texts_are_the_librarys():
    from tokenizers import Tokenizer

    r = np.random.default_rng(5)
    letters = list("abcdeinorst  ''!!.,7\n\tÉéß_-\xb2")
    texts = ["", " ", "'", "it's 's ' s", "<|endoftext|> x", "日本 abc", "a" * 300, *("".join(r.choice(letters, int(n))) for n in r.integers(0, 200, 400)), ""]
    x, library = tokenizing.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for t in texts * 2:
        assert np.frombuffer(x.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
