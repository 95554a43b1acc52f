"""Personal data: patterns against plain regular expressions, message passing against enumeration, the field on held-out text."""

from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logwarden.llm import private
from logwarden.llm.private import KINDS, added_spans, base_spans, find, learn, lesson, luhn, marginals, near


def plain(text):
    """The base spans as the contract words them."""
    out = [(1, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((2, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((3, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((4, *m.span()))
    return out


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("79927398713")


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@h-1.org", "@", "a@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (988) 555-2485", "+1", "+12 3", "++49 30 1234567", "é", "日本", " ", ".", "-", "12", "5", "@b.c", "a..b@c.d", "😀", "\n", "+(", "1 2 3 4 5 6 7 8"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "+1" + "(" * 300_000,
                                  "a.b@" + "c." * 100_000, "9" * 5000 + ".1.1.1"])
def test_time_grows_with_the_text(text):
    start = time.perf_counter()
    base_spans(text)
    assert time.perf_counter() - start < 5


def enumerate_marginals(own, edges, pair, potentials):
    n, labels = own.shape
    out = np.zeros((n, labels))
    for ys in itertools.product(range(labels), repeat=n):
        w = sum(own[i, y] for i, y in enumerate(ys)) + sum(potentials[k][ys[i], ys[j]] for (i, j), k in zip(edges, pair, strict=True))
        for i, y in enumerate(ys):
            out[i, y] += np.exp(w)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("edges, close", [([(0, 1), (1, 2), (1, 3), (3, 4)], 1e-3), ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 3), (1, 4)], 0.06), ([], 1e-9)])
def test_message_passing(edges, close):
    rng = np.random.default_rng(2)
    own, potentials = rng.normal(size=(5, 3)), rng.normal(size=(2, 3, 3)) * 0.6
    edges = np.array(edges, dtype=np.int64).reshape(-1, 2)
    pair = np.arange(len(edges)) % 2
    assert np.abs(marginals(own, edges, pair, potentials) - enumerate_marginals(own, edges, pair, potentials)).max() < close


WORDS = "the of a and river stone house green walked with light over under many more than never version page noon home".split()


def prose(rng, k=60):
    return " ".join(rng.choices(WORDS, k=k))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return learn([prose(rng) for _ in range(150)])


def spans_of(texts, model):
    base = [base_spans(t) for t in texts]
    return base, added_spans(near(pa.array(texts, pa.string())), model, base)


def test_held_out_texts(model):
    rng = random.Random(2)
    lessons = [lesson(prose(rng), rng) for _ in range(200)]
    base, added = spans_of([t for t, _ in lessons], model)
    right = wrong = missed = 0
    for (text, true), b, a in zip(lessons, base, added, strict=True):
        rest = [x for x in true if not any(x[1] < e and s < x[2] for _, s, e in b) and re.search("[0-9@]", text[x[1] : x[2]])]
        for k, s, e in a:
            assert not any(s < y and x < e for _, x, y in b)
            wrong += not any(k == k2 and s < y and x < e for k2, x, y in true)
        found = [x for x in rest if any(x[0] == k and x[1] < e and s < x[2] for k, s, e in a)]
        right, missed = right + len(found), missed + len(rest) - len(found)
    assert right / (right + missed) > 0.85
    assert wrong / (right + wrong) < 0.03


def test_clean_texts_stay_clean(model):
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        words = prose(rng).split()
        for _ in range(4):
            words.insert(rng.randint(0, len(words)), private.other_number(rng))
        texts.append(" ".join(words))
    base, added = spans_of(texts, model)
    assert sum(map(len, added)) <= 6


def test_label_travels_to_like_words(model):
    rng = random.Random(5)
    phone, doubtful = "+1 (415) 555-0132", "415/5550132"
    alone, linked = f"{prose(rng)} {doubtful} {prose(rng)}", f"{prose(rng)} {phone} {prose(rng)} {doubtful} {prose(rng)}"
    _, (without, with_it) = spans_of([alone, linked], model)
    x = near(pa.array([alone, linked]))
    net = private.nodes(x.words, x.place, x.doc)
    p = private.probabilities(net, model, private.labelled(x, [base_spans(alone), base_spans(linked)]))
    at = [i for i, w in enumerate(x.words) if w == doubtful]
    assert p[at[1], 4] > p[at[0], 4]
    assert not without or with_it


def test_links_grow_with_the_words():
    x = near(pa.array(["id123456 " * 500]))
    net = private.nodes(x.words, x.place, x.doc)
    assert len(net.edges) == 2 * 500 - 3


def rows():
    return [(1, "mail a.b1@c.org now", "x"), (2, None, "x"), (3, "", "x"), (None, "1.2.3.4 😀 +1 (988) 555-2485 é 4111111111111111", "x"),
            (4, "no data here", "x"), (4, "no data here", "x"), (5, "call 988-555-2485 " * 3 + "or +1 (988) 555-2485", "x"), (6, " \n\t", None)]


def test_query_columns(spark, model):
    df = spark.createDataFrame(rows(), "doc_id long, text string, base string").repartition(2)
    out = find(df, model).select("doc_id", "base", "added", private.shown(F.col("base")).alias("b"),
                                 private.shown(private.merged(F.col("base"), F.col("added"))).alias("all")).collect()
    assert len(out) == len(rows())
    want = sorted((",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in plain(t or "")) for _, t, _ in rows()))
    assert sorted(r["b"] for r in out) == want
    for r in out:
        both = [tuple(x) for x in r["base"]] + [tuple(x) for x in r["added"]]
        order = sorted(both, key=lambda x: (KINDS.index(x[0]), x[1]))
        assert r["all"] == ",".join(f"{k}:{s}:{e}" for k, s, e in order)


def test_fit_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find(empty).collect() == []
    df = spark.createDataFrame([(i, t) for i, t, _ in rows()], "doc_id long, text string")
    again = [private.fit(df), private.fit(df)]
    assert all((a == b).all() for a, b in zip(*again, strict=True))
    assert [r["base"] for r in find(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == [[], []]
