"""Near-duplicates against all pairs compared by plain counting."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from logwarden.llm import neardup
from logwarden.llm.common import scratch_folder
from logwarden.llm.components import components
from logwarden.llm.neardup import keep_one, labels, near_duplicates, samples


def weigh(texts):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    df = Counter(x for w in words for x in set(w))
    n = len(texts)

    def idf(word):
        return round(64 * (1 - math.log(df[word] / n))) if df[word] > 1e-3 * n else round(64 * (1 - math.log(1e-3)))

    out = []
    for w in words:
        size = min(5, len(w))
        found = Counter()
        for i in range(len(w) - size + 1) if w else ():
            found[tuple(w[i : i + size])] += sum(map(idf, w[i : i + size])) * 60 // size
        out.append(found)
    return out


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared) if a and b else 0


def brute(rows):
    weights = weigh([t for _, t in rows])
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(weights[i], weights[j]) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    members: dict[int, list] = {}
    for i, (doc, _) in enumerate(rows):
        members.setdefault(top(i), []).append(doc)
    return sorted(sorted(m, key=repr) for m in members.values() if len(m) > 1)


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(6, 150)))) for i in range(60)]
    for g in range(12):  # groups, and chains whose ends are not similar
        words = rng.choices(vocab, k=rng.randint(60, 200))
        for k in range(8):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((100 + 10 * g + k, " ".join(words)))
    passage = rng.choices(vocab, k=60)
    rows += [(300 + i, " ".join(rng.choices(vocab, k=50) + passage + rng.choices(vocab, k=20))) for i in range(30)]
    rows += [(400, "one two three"), (401, "one\ttwo  three"), (402, "one two"), (403, "one"), (404, "one")]
    rows += [(500, "again and again " * 40), (501, "again and again " * 41), (502, "again and again " * 80)]
    rng.shuffle(rows)
    return rows


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out: dict = {}
    for r in near_duplicates(df).collect():
        out.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(m, key=repr) for m in out.values() if len(m) > 1)


def test_equals_all_pairs(spark):
    rows = corpus()
    assert classes(spark, rows) == brute(rows)


def test_samples_collide_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    n, agree = 400, 0
    for _ in range(n // neardup.SAMPLES + 10):
        names = rng.integers(1, 2**63, 120, dtype=np.uint64)
        weight = rng.integers(1000, 9000, 120)
        other = weight.copy()
        other[:30] *= 3
        sides = []
        for w in (weight, other):
            order = np.argsort(names)
            sides.append(samples(np.zeros(120, int), names[order], w[order], 1)[:, 0])
        agree += (sides[0] == sides[1]).mean() - np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    assert abs(agree / (n // neardup.SAMPLES + 10)) < 0.06


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (None, "a b c d e f"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "q r s t u v"),
            (7, "x " * 30_000), (8, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_duplicates(df).collect())
    assert got == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (None, 6), (6, 6), (6, 6), (None, None), (7, 7), (8, 7)])
    wide = df.withColumns({"label": neardup.F.lit("x"), "node": neardup.F.lit(1), "row": neardup.F.lit(2)})
    kept = keep_one(wide)
    assert kept.columns == wide.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, None, 7])
    empty = df.limit(0)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == [] and labels(empty).collect() == []


def test_exact_threshold():
    column = pa.array(["a b c d e f g h i j k l m n", "a b c d e f g h"])
    none = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0), 1)
    assert neardup.similar_enough(column, pa.array(["a b c d e f g h i j k l", "a b c d e f g"]), none).tolist() == [True, False]
    assert neardup.similar_enough(column, pa.array(["a b c d e f g h i j k", "a b c d e f g h"]), none).tolist() == [False, True]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.label for r in components(df, scratch_folder(spark), "t").collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
