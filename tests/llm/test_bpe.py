"""BPE against the tokenizers library, and the long-word path against the short one."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tandem.llm import bpe  # noqa: E402

from .edge import ROWS, frame  # noqa: E402

MORE = [
    (30, "<|startoftext|>Hi <|endoftext|> <|EndOfText|>"), (31, "ΑΣ ΟΔΟΣ Σ"), (32, "a\x1cb\x1f c\x00\x85d​e é é İI"), (33, "it's we'll 'Twas 12 345"),
    (34, "aaaa" * 300 + " " + "abc!" * 200), (35, "日本語 テスト 😀😀 👨‍👩‍👧"), (36, "ǅ ß ẞ ﬁ Å"), (37, "…—“q”﻿ x"), (38, "Z" * 190 + " " + "Z" * 195),
]


@pytest.fixture(scope="module")
def model():
    return bpe.WordBpe(bpe.public_model())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_and_decoded_text_equal_the_library(spark, library):
    rows = ROWS + MORE
    got = bpe.encode_decode(frame(spark, rows), bpe.public_model()).collect()
    for (doc, text), r in zip(rows, sorted(got, key=lambda r: [i for i, x in enumerate(rows) if x[0] == r.doc_id][0])):
        want = library.encode(text or "", add_special_tokens=False)
        assert (r.doc_id, r.ids) == (doc, want.ids)
        assert r.decoded == library.decode(want.ids, skip_special_tokens=False)
    two = bpe.decode(bpe.encode(frame(spark, rows), bpe.public_model()), bpe.public_model())
    assert sorted(map(str, two.collect())) == sorted(map(str, got))
    assert bpe.digests(frame(spark).limit(0), bpe.public_model()).count() == 0


def test_random_words_equal_the_library_whatever_the_cache(model, library, monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdeinorst'é!?1 ") for _ in range(r.randint(1, 40))) for _ in range(40)) for _ in range(40)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in model.encode(texts)] == want
    monkeypatch.setattr(bpe, "CACHED", 3)
    assert [x.tolist() for x in model.encode(texts)] == want


def test_heap_and_scan_agree(model):
    r = random.Random(2)
    for _ in range(200):
        piece = "".join(r.choice("abcst") for _ in range(r.randint(1, 60))).encode()
        parts = [int(model.first[b]) for b in piece[:-1]] + [int(model.last[piece[-1]])]
        assert model._long(parts) == np.frombuffer(model.words([piece])[0], np.int32).tolist()
