"""Sharding against a directory that splits bucket by bucket."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logwarden.llm import sharding
from logwarden.llm.sharding import shards, write_shards


def brute(rows, limit):
    """Split one bucket at a time on another bit."""
    items = []
    for doc, text in rows:
        name = f"{'\x01' if doc is None else doc}\n{chr(1) if text is None else text}"
        items.append((doc, len((text or "").encode()), format(int(hashlib.md5(name.encode()).hexdigest()[:15], 16), "060b")))
    out = Counter()
    work = [("", items)]
    while work:
        bits, own = work.pop()
        if sum(n for _, n, _ in own) <= limit:
            out.update((d, n, bits or "all") for d, n, _ in own)
        elif len({h for _, _, h in own}) == 1:
            per = max(1, limit // own[0][1])
            out.update((d, n, f"{own[0][2]}.{i // per}") for i, (d, n, _) in enumerate(own))
        else:
            for b in "01":
                if part := [x for x in own if x[2].startswith(bits + b)]:
                    work.append((bits + b, part))
    return out


def corpus():
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(400)]
    rows += [(1000, "same" * 20)] * 200 + [(1001, "é" * 2000), (1002, None), (None, "null id"), (None, None), (1003, "")]
    return rows + [(7, f"one id, many texts {i}") for i in range(100)]


@pytest.mark.parametrize("limit", [100_000_000, 5000, 700])
def test_equals_bucket_by_bucket(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "'x' AS cell").repartition(3)
    got = shards(df, limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.shard) for r in got) == brute(rows, limit)
    size: dict = defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
    assert all(n <= limit or s.split(".")[1:] for s, n in size.items())
    assert all(r.depth == (0 if r.shard == "all" else len(r.shard.split(".")[0])) for r in got)


def test_files(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    write_shards(df, f"{tmp_path}/s", 5000)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{tmp_path}/s")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)


def test_empty_table(spark):
    assert shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = shards(df, 5000)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_hashes_of_different_rows_lose_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "row_hash", lambda ids, text: F.lit(5).cast("long") + F.length(text) * 0)
    rows = [(1, "one"), (2, "two"), (2, "two"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "text").collect()
    assert sorted(map(tuple, back)) == sorted(rows)
