"""Hard negatives for anchors: tiles of exact integer inner products by Strassen's recursion, and mergeable heaps.

Rows are packed into blocks of whole numbers.  Every anchor block meets every slice of candidate blocks, so a task holds
one anchor block, one candidate block and the heaps of its anchors, whatever the size of the tables.  Two passes over the
tiles follow, since a window of negatives is known only when its positive is:

1. the best rows of each anchor's own label, as one heap for each anchor and slice; heaps merge into positives;
2. the best rows of other labels inside the window of each positive, merged the same way.

A tile is a product of two matrices of 64-bit integers.  Strassen's recursion halves all three sides while they are long,
padding odd ones with zeros; its additions wrap around at 64 bits, so a product is exact whenever it fits 64 bits itself,
whatever its intermediate sums do.  Rows whose squares add up to 2**62 or more could break that and take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import scratch_folder, written

POSITIVES = NEGATIVES = 5
#: The window of a negative's score, in hundredths of its positive's.
LOW, HIGH = 80, 100
SCALE = 256
#: A product with a side of this length or less is multiplied directly.
LEAF = 32
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 2048
#: Bytes of numbers in a block; blocks of long vectors have fewer rows.
BLOCK_BYTES = 4 << 20
BLOCKS_A_TASK = 4
#: Anchors of a group and candidates of a slice, on average: a task multiplies a group by a slice.
GROUP_ROWS = SLICE_ROWS = 1 << 15
#: Rows that enter a Python worker together; a row of tiles is two blocks.
BATCH_ROWS = 16
MOST_SQUARES = 2.0**62

_BLOCK = "block long, n int, dims int, ids binary, labels binary, vectors binary"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()),
                          ("labels", pa.binary()), ("vectors", pa.binary())])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, modulo 2**64, with seven products of quarters at each level."""
    n, m, p = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m, p) <= leaf:
        return a @ b
    padded = (n + n % 2, m + m % 2, p + p % 2)
    if padded != (n, m, p):
        a = np.pad(a, ((0, padded[0] - n), (0, padded[1] - m)))
        b = np.pad(b, ((0, padded[1] - m), (0, padded[2] - p)))
    i, j, k = (x // 2 for x in padded)
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty(padded[::2], dtype=np.int64)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:n, :p]


def _pack(most_rows: int):
    """Blocks of the rows of a task: their number is the task's and a count, so a task that runs again says the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        dims = number = 0
        base = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            vectors = np.zeros((len(held), dims), dtype=np.int64)
            for i, (_, _, v) in enumerate(held):
                vectors[i, : len(v)] = v
            ids, labels = (np.array([x[c] for x in held], dtype=np.int64).tobytes() for c in (0, 1))
            row = [base + number, len(held), dims, ids, labels, vectors.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)

        for batch in batches:
            lists = batch.column("vector")
            values, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for i, (own, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                v = values[at[i] : at[i + 1]]
                wide = max(dims, len(v))
                if held and (len(held) == most_rows or (len(held) + 1) * wide * 8 > BLOCK_BYTES):
                    yield block()
                    held, number, wide = [], number + 1, len(v)
                dims = wide
                held.append((own, label, v))
        if held:
            yield block()

    return run


class Block:
    """The arrays of one row of a table of blocks."""

    def __init__(self, row: pd.Series, prefix: str = ""):
        self.block = row[f"{prefix}block"]
        self.ids, self.labels, vectors = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "labels", "vectors"))
        self.vectors = vectors.reshape(row[f"{prefix}n"], row[f"{prefix}dims"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            own = np.frombuffer(ids, np.int64)
            columns = [np.full(len(own), block), np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["block", "row", "anchor_id"])


def products(a: Block, c: Block) -> np.ndarray:
    """Scores of a tile; the shorter of two vectors is padded with zeros."""
    dims = min(a.vectors.shape[1], c.vectors.shape[1])
    return strassen(np.ascontiguousarray(a.vectors[:, :dims]), np.ascontiguousarray(c.vectors[:, :dims].T))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher scores first, then smaller ids."""
    if len(scores) > 4 * k:  # those below the k-th best score cannot be among them
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Heaps:
    """The ``k`` best (score, id) of each key; what two heaps of a key hold merges into one."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.of:
            top, own = self.of[key]
            if len(top) == self.k:
                some = scores >= top[-1]
                scores, ids = scores[some], ids[some]
            scores, ids = np.concatenate((top, scores)), np.concatenate((own, ids))
        at = best(scores, ids, self.k)
        self.of[key] = scores[at], ids[at]

    def frame(self, columns: list[str]) -> pd.DataFrame:
        rows = [(*key, i, s) for key, (scores, ids) in self.of.items() for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=columns)


_HEAP = ["block", "row", "place", "id", "score"]


def inside(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """``low * positive <= 100 * score <= high * positive`` without products that could pass 64 bits."""
    return (scores >= -(-low * positive // 100)) & (scores <= high * positive // 100)


def _heaps(k: int, window: tuple[int, int] | None):
    """Heaps of the tiles of a task: of the anchor's own label, or inside the windows of its positives."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps, at = Heaps(k), None
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                a, c = Block(row, "a_"), Block(row)
                if at not in (None, a.block):  # tiles of one anchor block follow each other, so few heaps are held
                    yield heaps.frame(_HEAP)
                    heaps = Heaps(k)
                at = a.block
                scores = products(a, c)
                if window is None:
                    asked = [(i, 0, 0) for i in range(len(a.ids))]
                else:
                    asked = np.frombuffer(row["a_asked"], np.int64).reshape(-1, 3).tolist()
                for i, place, positive in asked:
                    own = (c.labels == a.labels[i]) if window is None else (c.labels != a.labels[i]) & inside(scores[i], positive, *window)
                    own = np.flatnonzero(own & (c.ids != a.ids[i]))
                    if len(own):
                        heaps.add((a.block, i, place), scores[i, own], c.ids[own])
        yield heaps.frame(_HEAP)

    return run


def _asked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Row, place and score of the positives of one anchor block, of which there are a block's rows times ``positives``."""
    rows = pdf[["row", "place", "score"]].to_numpy(np.int64)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "asked": [rows.tobytes()]})


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The heaps of all slices as one, with ``rank``; Spark limits each side of the shuffle to ``k`` rows a heap."""
    order = Window.partitionBy("block", "row", "place").orderBy(F.desc("score"), F.asc("id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(anchors: DataFrame, candidates: DataFrame, groups: int, slices: int) -> DataFrame:
    """Every anchor block beside every candidate block, dealt by (group of anchor blocks, slice of candidate blocks)."""
    left = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)).withColumns({
        "group": F.pmod(F.xxhash64("a_block"), F.lit(groups)), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    })
    right = candidates.withColumns({
        "slice": F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"),
        "group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))),
    })
    return left.join(right.hint("merge"), ["group", "slice"])


def valid_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, vector`` (whole numbers) of the rows that take part."""
    plain = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(2.0**31 / scale)))
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    there = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & plain
    return rows.where(there).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), numbers.alias("vector")
    ).where(squares < MOST_SQUARES)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is the inner product of two rows, higher first, then the smaller id.
    An anchor (``is_anchor``, a condition on the column ``id``) has as positives its ``positives`` best other rows of its
    label; each has the ``negatives`` best rows of another label whose score lies between ``low`` and ``high`` hundredths
    of its own.

    Rows with a null id, label, vector or component, or one that is not finite, take no part, nor do vectors so long that
    a product might not fit 64 bits (a component of 2**31 or more after scaling, or squares that add up to 2**62).  Vectors
    of different length meet as if the shorter one ended in zeros; an empty vector has the score 0 with all.  Rows are
    told apart by their id: a row is no partner of another one with its id, and otherwise repeated rows count as often as
    they occur, as anchors too.  Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    valid = valid_rows(rows, id_col, vector_col, label_col, scale)
    sizes = valid.agg(F.count("*").alias("all"), F.count_if(is_anchor).alias("anchors")).first()

    def packed(part: DataFrame, n: int, rows_a_block: int, name: str) -> DataFrame:
        return written(part.repartition(max(1, math.ceil(n / (BLOCKS_A_TASK * rows_a_block)))).mapInArrow(_pack(rows_a_block), _BLOCK), folder, name)

    candidates = packed(valid, sizes["all"], CANDIDATE_ROWS, "candidates")
    anchors = packed(valid.where(is_anchor), sizes["anchors"], ANCHOR_ROWS, "anchors")
    groups = max(1, math.ceil(sizes["anchors"] / GROUP_ROWS))
    # a slice of few blocks keeps all cores busy on a small table
    least = min(2 * spark.sparkContext.defaultParallelism, math.ceil(sizes["all"] / CANDIDATE_ROWS))
    slices = max(1, least, math.ceil(sizes["all"] / SLICE_ROWS))
    schema = "block long, row long, place long, id long, score long"
    found = _met(anchors, candidates, groups, slices).mapInPandas(_heaps(positives, None), schema)
    near = written(_merged(found, positives).withColumn("place", F.col("rank").cast("long")).drop("rank"), folder, "positives")
    asked = anchors.join(near.groupBy("block").applyInPandas(_asked, "block long, asked binary"), "block")
    hard = _met(asked, candidates, groups, slices).mapInPandas(_heaps(negatives, (low, high)), schema)
    ranked = _merged(hard, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    names = anchors.select("block", "ids").mapInArrow(_names, "block long, row long, anchor_id long")
    known = near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(names, ["block", "row"])
    return known.join(ranked, ["block", "row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
