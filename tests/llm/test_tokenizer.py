"""The batched encoder against plain calls of the library."""

import random

import numpy as np

from rillflow.llm import tokenizer
from rillflow.llm.queries import tokenizer_path

PARTS = list("aZé ß1٣²  \n\t\r''''smtdrevl.,!?-_ 　\u0085᠎\x1c\x00中文😀éªⅧ​") + ["'s", "'re", "'ll", " '", "  ", "don't", "<|endoftext|>"]


def plain(e, text):
    return np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_plain_calls(monkeypatch):
    e, r = tokenizer.encoder(tokenizer_path()), random.Random(3)
    assert e.by_pieces
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 40))) for _ in range(5000)]
    want = [plain(e, t) for t in texts]
    assert e.encode_many(texts) == want
    assert e.encode_many([None, "", *texts[:50], None]) == [b"", b"", *want[:50], b""]
    assert e.encode_many([]) == []


def test_long_texts_are_cut_where_pieces_start(monkeypatch):
    monkeypatch.setattr(tokenizer, "BATCH", 50)
    e, r = tokenizer.encoder(tokenizer_path()), random.Random(4)
    texts = [" ".join(r.choices(["the", "it's", "naïve", "", "x\n", "a1", "中文"], k=400)) for _ in range(20)] + ["a" * 500]
    assert e.encode_many(texts) == [plain(e, t) for t in texts]
