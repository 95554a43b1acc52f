"""Classifier chain: features by hand, held-out accuracy, out-of-fold training, edge cases."""

from __future__ import annotations

import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logwarden.llm import toxicity
from logwarden.llm.toxicity import features, fit, predict


def plain(text):
    data = (text or "").lower().encode()
    words = re.findall(rb"[a-z\x80-\xff]+", data)
    padded = b"\0\0" + re.sub(rb"[^a-z\x80-\xff]", b"\0", data) + b"\0\0"
    grams = [padded[i - 2 : i + 3] for i in range(2, len(padded) - 2) if 0 not in padded[i - 1 : i + 2]]
    return len(words), len(set(words)), len(grams)


def test_features():
    texts = ["You idiot, you!", None, "", "a", "ab abc", "ÉTÉ été 12", "x" * 3000]
    doc, hashed = features(pa.array(texts))
    for i, text in enumerate(texts):
        words, _, grams = plain(text)
        assert (doc == i).sum() == words + grams
    same, _ = (set(hashed[doc == i].tolist()) for i in (0, 4))
    again_doc, again = features(pa.array(["zz", "You idiot, you!"]))
    assert set(again[again_doc == 1].tolist()) == same


def corpus():
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        words = rng.choices(vocab, k=rng.randint(5, 300))
        rude = rng.random() < 0.2
        loud = rng.random() < 0.3
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "nitwit,", "Blockhead"])
        if loud:
            words.append("zzzap!!")
        rows.append((i, " ".join(words)))
        # the last category follows from the others
        labels.append((i, int(loud), int(rude), int(rude and loud)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, loud int, rude int, both int")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    chain = fit(docs, marks.where(~out), ["loud", "rude", "both"])
    assert [len(m.dense) for m in chain.models] == [0, 1, 2]
    assert (chain.models[2].dense > 0).all()
    got = {r.doc_id: r for r in predict(docs, chain).collect()}
    tested = [x for x in labels if crc32(str(x[0]).encode()) % 3 == 1]
    for k, c in enumerate(chain.categories):
        right = [bool(x[k + 1]) == got[x[0]][c] for x in tested]
        assert sum(right) / len(right) > 0.97, c


def test_earlier_predictions_are_out_of_fold(spark, monkeypatch):
    seen = []
    plain_fit = toxicity.Logistic.fit

    def spy(self, row, column, dense, y, **more):
        seen.append((len(y), dense.shape[1]))
        return plain_fit(self, row, column, dense, y, **more)

    monkeypatch.setattr(toxicity.Logistic, "fit", spy)
    rows, labels = corpus()
    marks = spark.createDataFrame(labels[:300], "doc_id long, loud int, rude int, both int")
    fit(spark.createDataFrame(rows, "doc_id long, text string"), marks, ["loud", "rude"])
    assert [d for _, d in seen] == [0] * 4 + [1] * 4
    assert sum(n for n, _ in seen[1:4]) == 2 * seen[0][0] == 600


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you fool"), (1, "you fool"), (2, None), (None, "fool"), (3, ""), (4, "word " * 50_000)],
                                 "doc_id long, text string").withColumns({"toxic": F.lit("x"), "fold": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = predict(docs, fit(docs, labels, ["toxic"])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"]
    assert all(0 <= r.p_toxic <= 1 for r in got)
    nothing = fit(docs, labels.limit(0), ["toxic"])
    assert not any(r.toxic for r in predict(docs, nothing).collect())
    assert predict(docs.limit(0), nothing).collect() == []


def test_sample_is_bounded(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, loud int, rude int, both int")
    chain = fit(spark.createDataFrame(rows, "doc_id long, text string"), marks, ["loud"], most_rows=200)
    assert np.abs(chain.models[0].weights).max() > 0
