"""Packing: the plan against a bin-by-bin best fit, and every piece in its place."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from logwarden.llm import packing
from logwarden.llm.packing import best_fit, bin_texts, pack


def plain(lengths, capacities, overhead):
    """The same rules one piece at a time: capacity and contents of every bin."""
    left = sorted(lengths, reverse=True)
    bins: list[list] = []  # capacity, pieces

    def fill(capacity, rest):
        filled = 0
        for n in rest:
            if filled + n <= capacity:
                filled += n
        return filled

    while left:
        n = left[0]
        fit = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fit:
            best = min(fit, key=lambda b: b[0] - sum(b[1]))
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / fill(c, left), -c))
            same = left.count(n)
            # pieces of one length decide together
            for _ in range(-(-same // (c // n))):
                bins.append([c, []])
            best = bins[-(-(-same // (c // n)))]
        best[1].append(n)
        left.pop(0)
    return Counter((min(c for c in capacities if c >= sum(x)), sum(x)) for _, x in bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_piece_by_piece(seed):
    rng = random.Random(seed)
    capacities = [(8, 16, 32), (10, 25, 70), (64,), (3, 5, 7, 100)][seed % 4]
    lengths = [rng.randint(1, capacities[-1]) if rng.random() < 0.5 else rng.randint(1, 5) for _ in range(rng.randint(1, 150))]
    plan = best_fit(Counter(lengths), capacities, 2)
    got: Counter = Counter()
    for filled, n in zip(plan.filled.tolist(), plan.bin_count.tolist(), strict=True):
        got[min(c for c in capacities if c >= filled), filled] += n
    assert sum(f * n for (_, f), n in got.items()) == sum(lengths)
    assert got == plain(lengths, capacities, 2)


def corpus():
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.choice([1, 3, 7, 7, 7, 20, rng.randint(1, 90)])))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, " \n"), (None, "a b c"), (7, "x y"), (7, "x y"), (500, "long " * 1000)]


def test_every_word_has_a_place(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 40)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bin_id", "2 AS piece").repartition(3)
    got = pack(df, (16, 32, 64), 2).collect()
    assert Counter((r.doc_id, r.n_words, r.piece) for r in got) == Counter(
        (d, len((t or "").split()), p) for d, t in rows for p in range(max(1, -(-len((t or "").split()) // 64)))
    )
    taken: dict = defaultdict(list)
    for r in got:
        if r.piece_words == 0:
            assert r.bin_id is None and r.capacity is None
            continue
        assert r.piece_start + r.piece_words <= r.n_words
        taken[r.bin_id, r.capacity, r.bin_words].append((r.bin_offset, r.piece_words))
    for (_, capacity, filled), own in taken.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == filled and capacity == min(c for c in (16, 32, 64) if c >= filled)
    assert len({b for b, _, _ in taken}) == len(taken) == max(b for b, _, _ in taken) + 1
    want = best_fit(Counter(n for own in taken.values() for _, n in own), (16, 32, 64), 2)
    assert Counter(f for (_, _, f) in taken) == Counter({f: n for f, n in zip([], [])}) + Counter(
        x for f, n in zip(want.filled.tolist(), want.bin_count.tolist(), strict=True) for x in [f] * n
    )


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bin_texts(spark):
    rows = [(1, "a b c"), (2, "d\te"), (3, "f g h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = bin_texts(pack(df, (4, 8), 0), df).collect()
    assert sorted(" ".join(r.text for r in out).split()) == list("abcdefghijklmn")
    assert all(len(r.text.split()) == r.bin_words <= r.capacity for r in out)
