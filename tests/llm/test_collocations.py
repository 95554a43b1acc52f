"""Collocations against a count of all phrases in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from logwarden.llm import collocations
from logwarden.llm.collocations import mine, tokens


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, longest, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        longer = Counter()
        for p, a in f.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and longer[p] < a:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["The", "the", "É", "日本", "a b", "x'y", "\u0000", "."]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(vocab, weights, k=rng.randint(0, 80)))
        text = text.replace(" w3 ", rng.choice([", ", " w3\t", "\n", " ; ", " w3  "]))
        rows.append((text + (" new york city hall now" if i % 3 else " of The"), ("en", "fr", None, "und")[i % 4]))
    rows += [(None, "en"), ("", "fr"), (" \t\n", "de"), ("alone", "es"), ("w1 w2 " * 3000, "en"), ("same row here", "fr"), ("same row here", "fr")]
    return rows


def found(df, **kw):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in mine(df, **kw).collect())


@pytest.mark.parametrize("least, longest, top", [(5, 5, 2000), (2, 3, 7), (20, 5, 2000)])
def test_equals_brute_force(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(collocations, "MOST_ENTRIES", 600)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert found(df, least=least, longest=longest, top=top) == brute(rows, least, longest, top)


def test_crowded_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_BITMAP", 32768)
    monkeypatch.setattr(collocations, "MOST_BITS", 32768)
    rows = [(f"{a} {b} {c}", "en") for a in "abcdef" for b in "abcdef" for c in "abcdef"] * 2
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, least=2) == brute(rows, 2, 5, 2000)


def test_products_beyond_64_bits(spark):
    df = spark.sql("SELECT 3000000000000L AS a, 4000000000000000L AS n, 5000000000000L AS l, 7000000000000L AS r")
    whole = collocations._whole
    top = (1000 * (whole(df.a) * whole(df.n))).cast("decimal(38,0)")
    row = df.select(top.alias("top"), (whole(df.l) * whole(df.r)).alias("below")).selectExpr("top div below AS score").first()
    assert row["score"] == 1000 * 3000000000000 * 4000000000000000 // (5000000000000 * 7000000000000)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert found(empty) == []
    rows = [("a b", "en")] * 3
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "text string, lang string, phrase int, n int")
    assert found(df, least=2) == brute(rows, 2, 5, 2000)


def test_pieces_and_words():
    t = tokens(pa.array(["A b.C\td", None, "e", "É f,,g\nh"]))
    assert [t.words[int(i)].as_py().decode() for i in t.word] == ["a", "b", "c", "d", "e", "É", "f", "g", "h"]
    assert [int(x) for x in t.doc] == [0, 0, 0, 0, 2, 3, 3, 3, 3]
    same = t.piece[1:] == t.piece[:-1]
    assert same.tolist() == [True, False, True, False, False, True, False, False]
