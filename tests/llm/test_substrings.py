"""Substring removal against a brute-force count of windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from logwarden.llm import substrings
from logwarden.llm.substrings import hash_bytes, remove_repeats


def brute(rows, size):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)] + ["é", "日本", "a b"]
    passage = " ".join(rng.choices(vocab, k=50))
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, f"{rng.choice(vocab)} {passage}\t{rng.choice(vocab)}\n x{i}") for i in range(20)]
    rows += [(200, "same words " * 60), (201, None), (202, ""), (203, " \n\t "), (None, passage), (204, passage[:40])]
    rows += [(205, "  lead " + passage.replace(" ", "\r\n")), (205, "  lead " + passage.replace(" ", "\r\n"))]
    rows += [(206, " ".join(rng.choices(vocab, k=30_000)))]
    return rows


def found(spark, rows, size=35):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, size).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows, 35)
    assert found(spark, rows, 3) == brute(rows, 3)


def test_wide_hashes_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(substrings, "hash_bytes", lambda total: 12)
    rows = corpus()
    assert found(spark, rows) == brute(rows, 35)


def test_chunks_of_doubled_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{x}" for x in range(3000)], k=40 + i))) for i in range(40)]
    rows.append((None, " ".join(f"n{x}" for x in range(50))))
    doubled = [row for row in rows for _ in range(2)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(doubled, len(rows)), "doc_id long, text string")  # a chunk each
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()]
    assert sorted(out, key=repr) == brute(doubled, 35)


def test_a_name_of_two_lists_is_an_error():
    lists = [np.array([[k, k, 0]], np.int64).tobytes() for k in (1, 2)]
    answers = pd.DataFrame([(b"name", "docs", x, None) for x in lists], columns=["chunk", "kind", "hashes", "places"])
    with pytest.raises(ValueError, match="one name"):
        substrings._settle(answers)


def test_intervals_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a b {passage} c"), (2, f"{passage} d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(x) for x in r.removed] for r in remove_repeats(df).collect()}
    assert spans == {1: [(2, 42)], 2: [(0, 40)]}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, n_words int, kept_text string")
    assert [tuple(r)[:4] for r in remove_repeats(odd).collect()] == [(1, 2, 0, "a b")]


def test_hash_width_grows_with_the_corpus():
    assert hash_bytes(0) == 8 and hash_bytes(10**10) == 9 and hash_bytes(10**14) > 11


def thue_morse(letters, swap=False):
    """Words of 2 ** n letters that every polynomial modulo 2**64 with an odd base takes for one."""
    out = "ab"
    while len(out) < letters:
        out += out.translate(str.maketrans("ab", "ba"))
    return out.translate(str.maketrans("ab", "ba")) if swap else out


def test_words_that_polynomials_confuse(spark):
    shared = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{shared} {thue_morse(4096)}"), (2, f"{shared} {thue_morse(4096, True)}")]
    assert found(spark, rows) == brute(rows, 35)
