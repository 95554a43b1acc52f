"""Language ID: slots against plain sets, held-out accuracy, edge cases."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import langid
from logwarden.llm.langid import fit, grams, identify, letter_stream, predict
from tests.conftest import SF


def plain_grams(text):
    stream, last = [], False
    for c in (text or "").lower():
        if c.isalpha():
            stream += [c] if last else [" ", c]
        last = c.isalpha()
    stream = "".join(stream) + " " if stream else ""
    return [Counter(stream[i : i + n] for i in range(len(stream) - n + 1)) for n in langid.LENGTHS]


TEXTS = ["Hello, world", None, "", "123 !!", "a", "ÀÉ ß日本語 x", "é" * 3000, " .a. b1c ", "Жук 𝒳y"]


def test_stream_and_grams():
    column = pa.array(TEXTS)
    stream, first = letter_stream(column)
    for i, text in enumerate(TEXTS):
        own = "".join(chr(int(c)) if c else " " for c in stream[first[i] : first[i + 1]])
        assert own == "".join(" " + w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    for (code, doc), n in zip(grams(column), range(2), strict=True):
        for i, text in enumerate(TEXTS):
            want = plain_grams(text)[n]
            have = Counter(code[doc == i].tolist())
            assert sorted(have.values()) == sorted(want.values())


def test_masks_hold_all_languages_of_an_ngram(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ka", "zu", "re"], "cc": ["xo", "qi", "wy"]}
    rows = [(i, "".join(rng.choices(syllables[x], k=40)), x) for i in range(60) for x in syllables]
    filters = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.langs == ["aa", "bb", "cc"]
    total, seen = Counter(), Counter()
    for _, text, lang in rows:
        for n, own in enumerate(plain_grams(text)):
            total[lang, n] += own.total()
            seen.update({(lang, n, g): c for g, c in own.items()})
    share = {k: c / total[k[:2]] for k, c in seen.items()}
    for n in (0, 1):
        text = " ".join(sorted({"".join(rng.choices(["ka", "lo", "zu", "xo"], k=3)) for _ in range(30)}))
        code, _ = grams(pa.array([text]))[n]
        mask = np.bitwise_and.reduce([filters.table[p, 0] for p in langid.slots(code)])
        stream = "".join(chr(int(c)) if c else " " for c in letter_stream(pa.array([text]))[0])
        size = langid.LENGTHS[n]
        extra = 0
        for i, m in enumerate(mask.tolist()):
            gram = stream[i : i + size]
            best = max(share.get((x, n, gram), 0) for x in filters.langs)
            want = sum(1 << b for b, x in enumerate(filters.langs)
                       if (s := share.get((x, n, gram), 0)) >= langid.FLOOR and s >= langid.KEEN * best)
            assert m & want == want  # a Bloom filter forgets nothing
            extra += m != want
        assert extra <= 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    rows = [(1, "the cat", "en"), (1, "the cat", "en"), (2, None, "en"), (3, "12 34", "fr"), (None, "le chat", "fr"), (5, "the", None),
            (6, "qqqq", "en"), (7, "", "de"), (8, "the " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("mine"))
    filters = fit(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict(df, filters).collect()]
    assert Counter(d for d, _, _ in got) == Counter(r[0] for r in rows)
    pred = {d: (p, s) for d, p, s in got}
    assert pred[2] == pred[3] == pred[7] == ("und", 0.0)
    assert pred[1][0] == pred[5][0] == pred[8][0] == "en" and pred[None][0] == "fr"
    empty = df.limit(0)
    assert predict(empty, fit(empty)).collect() == [] and identify(empty).collect() == []
    unlearned = predict(df, fit(empty)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_many_languages(spark):
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(700)]
    rows = [(i, "".join(rng.choices(letters[10 * k : 10 * k + 10], k=60)), f"l{k:02}") for k in range(70) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = fit(df)
    assert filters.table.shape[1] == 2
    assert all(r.lang == r.lang_pred for r in predict(df, filters).collect())


@pytest.mark.parametrize("text", ["a", "ß", "a1"])
def test_a_single_letter_is_enough(spark, text):
    df = spark.createDataFrame([(1, "a ß", "en")], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(2, text)], "doc_id long, text string")
    assert predict(ask, fit(df)).first().lang_pred == "en"
