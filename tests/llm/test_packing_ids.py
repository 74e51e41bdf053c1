"""Ids of words that are split here and sent to the library's model, against the whole library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers as files

from catalens.llm.packing import Ids

PATH = files.path("word_bpe_49k.json")
PARTS = [
    "word", "Word", "WORD", "ÀÉÎ", "straße", "ÿ", "×", "÷", "é", "́", "Σ", "ΑΣ", "İ", "ı", "ſ", "K", "ﬁ", "µ", "ª", "²", "½",
    "中文", "🙂", "'s", "'S", "'ll", "'RE", "'", "''d", ".", ",%%%", "###", "1", "2024", "٣", "_", "\x00", "\x01", "\x07", "\x7f", "\xad",
    "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|", "q" * 70, "é" * 70, "​", "﻿", " ", "\n", "\t ", "\x0b", "\x85", "\xa0", "　",
]


def test_ids_are_those_of_the_library():
    r = random.Random(7)
    texts = ["", *PARTS, *("".join(r.choices(PARTS, k=r.randint(2, 12))) for _ in range(3000))]
    for limit in (3, 1000):
        own = Ids(PATH)
        own.words.limit = own.pretokens.limit = limit
        wanted = [np.array(own.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert list(own(texts)) == wanted
        for known in (own.words, own.pretokens):
            assert len(known) <= limit and len(known.older) <= limit and max(map(len, known)) <= 64
        own.forget()
        assert not (own.words or own.words.older or own.pretokens or own.pretokens.older)


def test_a_pretoken_is_encoded_once():
    own, asked = Ids(PATH), []
    encode = own.tokenize
    own.tokenize = lambda x: asked.append(x) or encode(x)
    list(own(["stone Stone, (STONE) stone's stone.", "stone stone, Stone."]))
    assert sorted(asked) == sorted(["stone", ",", "(", ")", "'s", "."])
