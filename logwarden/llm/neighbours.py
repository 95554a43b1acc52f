"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy graph search for the queries.

Vectors travel as codes (one signed byte a component and a scale), which is enough to steer the search; all nodes of a
query's final beam are ranked by exact distances of the original vectors in double precision.  Equal vectors are one node.

* Start: random hyperplanes put nodes into small buckets, and each node takes its nearest ones there.  A bucket of near
  copies is divided by a hash, so no bucket grows with the data.
* Descent: each node joins its ``DEGREE`` nearest with as many nodes that have it among theirs, and proposes its neighbours
  to each other, the ``PROPOSED`` nearest to each.  Spark brings the proposals to their nodes, which keep the nearest.
* Search: all queries go together.  In each round a query expands its nearest nodes that were not expanded yet: their rows of
  the graph are joined to it, and it keeps the ``BEAM`` nearest of all it has seen.

* Exact: a query that codes cannot serve (see :func:`search`) is ranked against all vectors, block by block, and a node
  that the start left without a neighbour gets its edges that way.

Numbers of neighbours, proposals and rounds are parameters of the method; recall against brute force is measured in the
tests and reported in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import scratch_folder, tidy_arrow, written

DEGREE = 20
PROPOSED = 5
STARTS = 6
BUCKET = 64
DESCENTS = 4
BEAM = 400
EXPANDED = 200
ROUNDS = 6


def encode(vector: np.ndarray) -> bytes:
    """A code: one signed byte for each component, then the scale."""
    scale = float(np.abs(vector).max()) / 127
    return np.rint(vector / scale).astype(np.int8).tobytes() + np.float64(scale).tobytes()


def decode(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of equal length as a matrix of whole numbers, and their scales."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, :-8].view(np.int8).astype(np.float32), np.ascontiguousarray(raw[:, -8:]).view(np.float64).ravel()


def squared(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Squared distances of coded vectors; the same pair always has the same one, as products of bytes add up exactly."""
    na, nb = ((x.astype(np.float64) ** 2).sum(axis=1) * s * s for x, s in ((a, sa), (b, sb)))
    dots = (a @ b.T).astype(np.float64)
    return np.maximum(na[:, None] + nb[None, :] - 2 * (sa[:, None] * sb[None, :]) * dots, 0)


def proposals(ids: np.ndarray, codes: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the nodes its ``most`` nearest among the others: node, other, squared distance."""
    m = len(ids)
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    c, s = decode(codes)
    d = squared(c, s, c, s)
    np.fill_diagonal(d, np.inf)
    k = min(most, m - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < m - 1 else np.argsort(d, axis=1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, axis=1).ravel()


_PROPOSAL = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v, dtype=np.float64) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(v) for v in vectors], pa.int32()), pa.array([encode(v) for v in vectors], pa.binary())],
            names=["id", "dim", "code"],
        )


def _buckets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, codes = batch.column("dim").to_numpy(), batch.column("code").to_pylist()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                c, _ = decode([codes[i] for i in own])
                for start in range(STARTS):
                    if (start, dim) not in planes:
                        planes[start, dim] = np.random.default_rng(1000 * start + int(dim)).standard_normal((dim, bits))
                    side = (c @ planes[start, dim] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), start, np.int32)), *(batch.column(x).take(pa.array(own)) for x in ("dim", "id", "code")),
                         pa.array(side.astype(np.int64))],
                        names=["start", "dim", "id", "code", "side"],
                    )

    return run


def _propose_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
    a, b, d = proposals(bucket["id"].to_numpy(), bucket["code"].tolist(), DEGREE)
    return pd.DataFrame({"a": a, "b": b, "d": d})


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals among a node, its neighbours and the nodes that have it as neighbour."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            near = {row["id"]: row["code"]} | {x["b"]: x["code"] for x in (row["near"] or []) + (row["back"] or [])}
            found.append(proposals(np.array(list(near), dtype=np.int64), list(near.values()), PROPOSED))
            if len(found) == 200:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=_PROPOSAL)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=_PROPOSAL)


def _nearest(edges: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` nearest different neighbours of each node.  Equal edges have one rank; the limit works before the shuffle too."""
    other = "b" if by == "a" else "a"
    # equal distances in an order of the pair's own: by id, all would choose the same few
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("d", F.xxhash64("a", "b"), other))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").groupBy(by, other).agg(F.min("d").alias("d"))


def _lists(edges: DataFrame, codes: DataFrame, key: str, name: str) -> DataFrame:
    """Neighbours of each node with their codes, as a list; the degree bounds it."""
    other = "b" if key == "a" else "a"
    full = edges.join(codes.select(F.col("id").alias(other), "code"), other)
    return full.groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col(other).alias("b"), "code")).alias(name))


_BLOCK = "dim int, ids binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a batch as one matrix per dimension, in the order of their ids."""
    for batch in batches:
        by: dict[int, list] = {}
        for i, v in sorted(zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True), key=lambda x: x[0]):
            by.setdefault(len(v), []).append((i, v))
        rows = [(dim, np.array([i for i, _ in own], np.int64).tobytes(), np.array([v for _, v in own], np.float64).tobytes()) for dim, own in by.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["dim", "ids", "vectors"],
            )


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, ids = np.frombuffer(row["qs"], np.int64), np.frombuffer(row["ids"], np.int64)
                a, b = (np.frombuffer(row[c], np.float64).reshape(-1, row["dim"]).T for c in ("asked", "vectors"))
                total = np.zeros((len(q), len(ids)))
                for x, y in zip(a, b, strict=True):  # summed in the order in which Spark sums
                    step = x[:, None] - y[None, :]
                    total += step * step
                near = np.argsort(total, axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q, near.shape[1])), pa.array(ids[near].ravel()), pa.array(np.sqrt(np.take_along_axis(total, near, axis=1)).ravel())],
                    names=["q", "id", "score"],
                )

    return run


def against_all(asked: DataFrame, vectors: DataFrame, most: int, parts: int) -> DataFrame:
    """``q, id, score``: the ``most`` nearest of the nodes ``vectors`` to each of the nodes ``asked`` (both ``id, vector``),
    itself included, by exact distance and then id."""
    blocks = vectors.select("id", "vector").mapInArrow(_pack, _BLOCK).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    wanted = asked.select("id", "vector").mapInArrow(_pack, _BLOCK).select(
        "dim", F.col("ids").alias("qs"), F.col("vectors").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    )
    found = blocks.join(wanted, ["dim", "part"]).select("dim", "qs", "asked", "ids", "vectors").mapInArrow(_compare(most), "q long, id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    return found.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def parts_of(n: int) -> int:
    """Parts into which the blocks of ``n`` nodes are dealt; this sets how many tasks compare them, not what is compared."""
    return max(1, min(2000, math.ceil(n / 2000)))


def build(vectors: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Codes ``id, dim, code`` of the nodes ``id, vector``, and the graph ``a, b, d``: the nearest nodes found for each."""
    codes = written(vectors.mapInArrow(_codes, "id long, dim int, code binary"), folder, "codes")
    n = codes.count()
    bits = max(1, math.ceil(math.log2(max(2, n / BUCKET))))
    spread = codes.mapInArrow(_buckets(bits), "start int, dim int, id long, code binary, side long")
    size = spread.groupBy("start", "dim", "side").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("id", "start"), F.ceil(F.col("n") / (2 * BUCKET)))
    first = spread.join(size, ["start", "dim", "side"]).withColumn("salt", salt).groupBy("start", "dim", "side", "salt").applyInPandas(
        _propose_bucket, "a long, b long, d double"
    )
    graph = written(_nearest(first, "a", DEGREE), folder, "start")
    alone = vectors.join(graph.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    joined = against_all(alone, vectors, DEGREE + 1, parts_of(n)).where("q != id").select(
        F.col("q").alias("a"), F.col("id").alias("b"), (F.col("score") * F.col("score")).alias("d")
    )
    both = joined.unionByName(joined.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    graph = written(graph.unionByName(both), folder, "graph-0")
    for step in range(1, DESCENTS + 1):
        near = _lists(graph, codes, "a", "near")
        back = _lists(_nearest(graph, "b", DEGREE), codes, "b", "back")
        joined = codes.select("id", "code").join(near, "id", "left").join(back, "id", "left")
        proposed = joined.mapInArrow(_propose, "a long, b long, d double")
        graph = written(_nearest(graph.unionByName(proposed), "a", DEGREE), folder, f"graph-{step}")
    return codes, graph


class Beam:
    """What a query knows: nodes seen, their squared distances, and which were expanded."""

    @staticmethod
    def merge(state: tuple, ids: np.ndarray, codes: list[bytes], code: bytes) -> tuple:
        seen, pool, dist, done = state
        ids, place = np.unique(ids, return_index=True)
        new = ~np.isin(ids, seen)
        ids, place = ids[new], place[new]
        if len(ids):
            c, s = decode([codes[i] for i in place])
            q, sq = decode([code])
            pool = np.concatenate((pool, ids))
            dist = np.concatenate((dist, squared(q, sq, c, s)[0]))
            done = np.concatenate((done, np.zeros(len(ids), np.uint8)))
            order = np.lexsort((pool, dist))[:BEAM]
            pool, dist, done = pool[order], dist[order], done[order]
            seen = np.concatenate((seen, ids))
        return seen, pool, dist, done

    @staticmethod
    def next(pool: np.ndarray, done: np.ndarray) -> np.ndarray:
        return np.flatnonzero(done == 0)[:EXPANDED]


def _frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, queries = [], []
        for q, pool, done in zip(*(batch.column(c).to_pylist() for c in ("q", "pool", "done")), strict=True):
            own = np.frombuffer(pool, np.int64)[Beam.next(np.frombuffer(pool, np.int64), np.frombuffer(done, np.uint8))]
            nodes.append(own)
            queries.append(np.full(len(own), q, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, queries)], names=["id", "q"])


_STATE = "q long, code binary, seen binary, pool binary, dist binary, done binary"


def _advance(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    if not len(state):
        return state
    row = state.iloc[0]
    seen, pool, dist, done = (np.frombuffer(row[c], k) for c, k in (("seen", np.int64), ("pool", np.int64), ("dist", np.float64), ("done", np.uint8)))
    done = done.copy()
    done[Beam.next(pool, done)] = 1
    ids = [x["b"] for near in found["near"] for x in near]
    codes = [x["code"] for near in found["near"] for x in near]
    seen, pool, dist, done = Beam.merge((seen, pool, dist, done), np.array(ids, dtype=np.int64), codes, row["code"])
    return pd.DataFrame([(row["q"], row["code"], seen.tobytes(), pool.tobytes(), dist.tobytes(), done.tobytes())], columns=list(state.columns))


def unsure(code: bytes, dist: np.ndarray, k: int) -> bool:
    """Whether a beam may miss one of the ``k`` nearest because of the codes: it is not full, so the search ran dry; or the
    errors of the codes reach over the ``k``-th distance, or from there to the end of the beam."""
    if len(dist) < max(BEAM, k + 1):
        return True
    _, scale = decode([code])
    error = 4 * math.sqrt(len(code) - 8) / 2 * float(scale[0])
    kth, last = math.sqrt(dist[k]), math.sqrt(dist[-1])
    return kth <= error or last - kth <= error


def search(queries: DataFrame, codes: DataFrame, graph: DataFrame, folder: str, k: int) -> DataFrame:
    """``q, id, unsure``: the nodes in the final beam of each of the nodes ``queries`` (``q``), and whether codes suffice
    to find its ``k`` nearest; if not, ``id`` is null."""
    both = graph.select("a", "b", "d").unionByName(_nearest(graph, "b", DEGREE).select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    adjacent = written(_lists(both.distinct(), codes, "a", "near"), folder, "adjacent")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            own = [np.array([x], np.int64).tobytes() for x in q.to_pylist()]
            zero, flag = np.zeros(1).tobytes(), np.zeros(1, np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [q, batch.column("code"), pa.array(own), pa.array(own), pa.array([zero] * len(own)), pa.array([flag] * len(own))],
                names=["q", "code", "seen", "pool", "dist", "done"],
            )

    state = written(queries.join(codes, F.col("q") == F.col("id")).select("q", "code").mapInArrow(begin, _STATE), folder, "beam-0")
    for step in range(1, ROUNDS + 1):
        got = state.select("q", "pool", "done").mapInArrow(_frontier, "id long, q long").join(adjacent, "id").select("q", "near")
        state = written(state.groupBy("q").cogroup(got.groupBy("q")).applyInPandas(_advance, _STATE), folder, f"beam-{step}")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ids, flags = [], [], []
            for node, code, pool, dist in zip(*(batch.column(c).to_pylist() for c in ("q", "code", "pool", "dist")), strict=True):
                open_ = unsure(code, np.frombuffer(dist, np.float64), k)
                own = [None] if open_ else np.frombuffer(pool, np.int64).tolist()
                q += [node] * len(own)
                ids += own
                flags += [open_] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(flags, pa.bool_())], names=["q", "id", "unsure"])

    return written(state.select("q", "code", "pool", "dist").mapInArrow(end, "q long, id long, unsure boolean"), folder, "found")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row whose id is divisible by ``every``.

    Nearness is Euclidean distance; equal distances go to the smaller id.  Vectors that are null, empty or zero, or hold a
    null or non-finite component, and rows with a null id take no part.  A repeated id counts once (with its least
    vector).  Vectors of different lengths are never neighbours.  Other columns are not read.
    """
    spark = tidy_arrow(vectors.sparkSession)
    folder = scratch_folder(spark)
    plain = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.col(id_col).isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: x != 0
    )
    rows = vectors.select(F.col(id_col).cast("long"), plain.alias("vector")).where(F.coalesce(fit, F.lit(False)))
    rows = rows.groupBy(id_col).agg(F.min("vector").alias("vector"))
    # equal vectors are one node, named by its least id; -0.0 is 0.0
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    named = rows.withColumns({"_k1": F.xxhash64("vector"), "_k2": F.xxhash64(F.lit(1), "vector")})
    groups = named.groupBy("_k1", "_k2").agg(F.min(id_col).alias("id"))
    members = written(named.join(groups, ["_k1", "_k2"]).select(F.col(id_col).alias("member"), "id", "vector"), folder, "members")
    nodes = members.where("member = id").select("id", "vector")
    codes, graph = build(nodes, folder)
    asked = members.where(F.col("member") % every == 0).select(F.col("member").alias("query_id"), F.col("id").alias("q"))
    found = search(asked.select("q").distinct(), codes, graph, folder, k)
    exact = found.where("NOT unsure").select("q", "id").join(nodes.select(F.col("id").alias("q"), F.col("vector").alias("_q")), "q").join(nodes, "id").withColumn(
        "score", F.sqrt(F.aggregate(F.zip_with("_q", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ).select("q", "id", "score")
    order = Window.partitionBy("q").orderBy("score", "id")
    exact = exact.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    hard = nodes.join(found.where("unsure").select(F.col("q").alias("id")), "id", "left_semi")
    exact = exact.unionByName(against_all(hard, nodes, k + 1, parts_of(codes.count())))
    # of equal vectors the k + 1 least ids can be among a query's k nearest others
    least = members.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("member"))).where(F.col("_r") <= k + 1).select("id", "member")
    ranked = asked.join(exact, "q").join(least, "id").where("member != query_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "member"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")
