"""Hard negatives against all pairs in plain Python, Strassen's recursion against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import negatives
from logwarden.llm.negatives import inside, mine, strassen


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (64, 64, 64), (17, 40, 129), (0, 4, 4), (5, 0, 3)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    n, m, p = shape
    a, b = rng.integers(-(2**20), 2**20, (n, m)), rng.integers(-(2**20), 2**20, (m, p))
    assert (strassen(a, b, 4) == a @ b).all()


def test_strassen_wraps_and_still_fits():
    a = np.full((8, 8), 2**29, dtype=np.int64)  # sums of quarters pass 64 bits on the way
    b = a * np.where(np.arange(8) % 2, 2, -2)[:, None]
    assert (strassen(a * 2, b, 1) == 0).all()


def test_window_bounds():
    scores = np.array([79, 80, 81, 100, 101, 0, -1])
    assert scores[inside(scores, 100, 80, 100)].tolist() == [80, 81, 100]
    assert scores[inside(scores, 101, 80, 100)].tolist() == [81, 100, 101]
    assert scores[inside(scores, 0, 80, 100)].tolist() == [0]
    assert not inside(np.array([-100, -90, -80]), -100, 80, 100).any()


def brute(rows, k=5):
    valid = []
    for own, v, label in rows:
        if own is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((own, [math.floor(256 * x) for x in v], label))
    out = []
    for own, v, label in valid:
        if own % 10:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), other, lab) for other, w, lab in valid if other != own]
        for p, positive, _ in sorted(x for x in score if x[2] == label)[:k]:
            hard = sorted(x for x in score if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(own, positive, r, other, -p, -s) for r, (s, other, _) in enumerate(hard, 1)]
    return sorted(out)


def corpus(n=160, dims=40):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.5))) for x in c], rng.randint(0, 3)))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 2) for i in range(60)]  # ties
    rows += [(20, rows[20][1], 1), (1001, same, 1)]  # repeated ids and rows
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [float("nan")] * dims, 1), (2030, [float("inf")] * dims, 2)]
    rows += [(2040, same, None), (None, same, 1), (2050, [], 1), (2060, same[:5], 0), (2070, [*same, 1.0, 2.0], 0), (2080, [0.0] * dims, 2)]
    return rows


def found(df):
    return sorted(tuple(r) for r in mine(df, F.col("id") % 10 == 0).collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in {"ANCHOR_ROWS": 7, "CANDIDATE_ROWS": 13, "GROUP_ROWS": 10, "SLICE_ROWS": 40, "LEAF": 4}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1)).repartition(3)
    assert found(df) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert found(spark.createDataFrame([], kinds)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], kinds)) == []


def test_too_long_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 0), (10, [1e9, 0.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 1.9], 1), (3, [float(2**22)] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(df) == brute([x for x in rows if x[0] not in (10, 3)])
