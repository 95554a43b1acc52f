"""Approximate neighbours against brute force."""

from __future__ import annotations

import numpy as np

from logwarden.llm.neighbours import decode, encode, nearest, squared
from tests.conftest import SF


def brute(rows, k=10, every=100):
    own = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        own[i] = min(own.get(i, list(v)), list(v))
    ids = sorted(own)
    out = {}
    for q in ids:
        if q % every == 0:
            d = [(float(np.sqrt(((np.array(own[q], float) - np.array(own[i], float)) ** 2).sum())), i) for i in ids
                 if i != q and len(own[i]) == len(own[q])]
            out[q] = sorted(d)[:k]
    return out


def found(df, **more):
    out: dict = {}
    for r in sorted(nearest(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in d}) for q, d in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_codes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 16)) * rng.uniform(0.01, 100, (20, 1))
    c, s = decode([encode(v) for v in x])
    assert (np.abs(c * s[:, None] - x).max(axis=1) <= np.abs(x).max(axis=1) / 254 * 1.001).all()
    d = squared(c, s, c, s)
    assert (d == d.T).all() and np.allclose(np.diag(d), 0, atol=1e-6)


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(df)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.95
    for q, own in got.items():
        exact = dict((i, d) for d, i in brute([(r.vec_id, r.embedding) for r in df.collect()], 10**6)[q]) if q == 0 else {}
        assert all(abs(exact.get(i, d) - d) < 1e-12 for d, i in own)
        assert own == sorted(own)


def test_recall_on_clusters_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((15, 24))
    rows = [(i, (centres[i % 15] + 0.2 * rng.standard_normal(24)).tolist()) for i in range(2500)]
    rows += [(3000 + i, rows[100][1]) for i in range(400)]  # equal vectors
    rows += [(4000 + i, (np.array(rows[200][1]) + 1e-3 * rng.standard_normal(24)).tolist()) for i in range(300)]  # near copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want, got = brute(rows), found(df)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert [i for _, i in got[3000]] == [100, *range(3001, 3010)]


def test_large_group_of_equal_codes_and_an_outlier(spark):
    rng = np.random.default_rng(3)
    base, side = rng.standard_normal(24), rng.standard_normal(24)
    base[0] = 9.0  # the scale of the codes, so that the noise does not change them
    base[1:] = np.rint(base[1:] * 127 / 9) * 9 / 127
    rows = [(i, (side + 0.3 * rng.standard_normal(24)).tolist()) for i in range(1, 800)]
    rows += [(1000 + i, (base + 1e-3 * np.concatenate(([0], rng.uniform(-1, 1, 23)))).tolist()) for i in range(1500)]
    rows += [(5000, (-50 * (base + side)).tolist())]  # opposite to all others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want, got = brute(rows), found(df)
    assert {q: [i for _, i in d] for q, d in got.items() if q >= 1000} == {q: [i for _, i in d] for q, d in want.items() if q >= 1000}
    assert recall(got, want) >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []),
            (None, [1.0, 1.0]), (100, [0.9, 0.1]), (100, [0.9, 0.1]), (7, [float("inf"), 0.0]), (8, [1.0, 2.0, 3.0]), (200, [3.0, 2.0, 1.0]), (300, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS q", "3 AS code")
    got, want = found(df), {q: d for q, d in brute(rows).items() if d}
    assert {q: [i for _, i in d] for q, d in got.items()} == {q: [i for _, i in d] for q, d in want.items()}
    assert found(df.limit(0)) == {}
