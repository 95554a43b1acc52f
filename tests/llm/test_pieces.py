"""Offset-preserving encoding against the library, on the model and on the library's own character maps."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from logwarden.llm.pieces import Encoder, Normalizer, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "Hello, world", "tabs\tand\nlines\r\n", "日本語 é \U0001f600 x", "▁▁ a▁b", "a\0b", "ﬁ ①  Ａ  é", "x" * 500,
    "  spaced   out  ", "<s> </s> <unk> <0x41>", "é ​﻿ z", "ｶﾞ㌔", "　wide　",
]


def mixed(seed, n=60):
    rng = random.Random(seed)
    signs = "abc  \n\té日①ﬁＡ▁\U0001f600́<0x>\0"
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_normalizer_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = Normalizer(library.serialized_model_proto())
    for text in TEXTS + mixed(1):
        want, offsets = library.normalize(text, with_offsets=True)
        made, source = own.normalize(text.encode())
        assert made.decode() == want, text
        # the library counts characters, the alignment bytes
        starts = np.cumsum([0] + [len(c.encode()) for c in want])
        assert [len(text.encode()[: source[i]].decode()) for i in starts] == offsets, text


def test_pieces_lead_back_to_the_text():
    with open(PATH, "rb") as file:
        encoder = Encoder(file.read())
    for text in TEXTS + mixed(2):
        data = text.encode()
        ids = encoder.library.encode(text)
        begin, end = encoder.spans(data, np.array(ids, dtype=np.int64))
        assert (begin <= end).all() and (begin[1:] >= end[:-1]).all()
        if ids:
            assert end[-1] == len(data) and begin[0] == 0
        proto = encoder.library.encode(text, return_type="proto")
        assert [p.id for p in proto.pieces] == ids
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]


def test_query_columns(spark):
    rows = list(enumerate(TEXTS)) + [(90, None), (None, "no id"), (7, "twice"), (7, "twice"), (91, "long words " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS pieces")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def want(doc, text):
        ids = library.encode(text or "")
        return doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = encode(df, PATH).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(repr(want(*r)) for r in rows)
    for r in got:
        assert len(r.pieces) == r.n_tokens and [p.id for p in r.pieces] == library.encode(r.decoded) or r.decoded != dict(rows).get(r.doc_id)
    assert encode(df, PATH, spans=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert encode(df.limit(0), PATH).collect() == []
