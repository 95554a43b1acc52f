"""Toxicity by a classifier chain over hashed words and letter sequences.

Categories are predicted one after the other by logistic models.  A later model has the log-odds of all earlier categories
among its features.  When it is trained, those are out-of-fold predictions: models that have not seen the row made them,
so the later model learns how far the earlier ones can be trusted on new texts.

The models are fitted on at most ``MOST_ROWS`` labelled rows, those with the smallest hash of their id; that bounds what the
driver holds.  Every document is scored, by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import pieces, scratch_folder, tidy_arrow, written
from logwarden.llm.words import mix, span_hashes, text_bytes

MOST_ROWS = 20_000
FEATURE_BITS = 20
#: Features kept for each category, those that tell most about it.
CHOSEN = 1000
FOLDS = 3
SEQUENCE = 5
_WORD_BASE = 0x8EBC6AF09C88C6E3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, with their documents, by document: lower-case words, and sequences of five bytes whose
    middle lies in a word (so the start and the end of a word count)."""
    data, at = text_bytes(pc.utf8_lower(column.fill_null("")))
    letter = ((data >= ord("a")) & (data <= ord("z"))) | (data >= 0x80)
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = letter[edge]
    ends[edge[1:] - 1] = letter[edge[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = span_hashes(np.where(letter, data, 0).astype(np.uint8), start, end, _WORD_BASE)
    # blanks around every document, so that no sequence reaches into another one
    gap = np.zeros(len(data) + 2 * (len(at) + 1), dtype=np.uint64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    gap[np.arange(len(data)) + 2 * doc + 2] = np.where(letter, data, 0)
    middle = np.flatnonzero(letter) + 2 * doc[letter] + 2
    own = (gap[middle - 1] > 0) & (gap[middle + 1] > 0) if len(middle) else np.zeros(0, bool)
    middle = middle[own]
    code = np.zeros(len(middle), dtype=np.uint64)
    for k in range(-2, 3):
        code = (code << np.uint64(8)) | gap[middle + k]
    hashed = np.concatenate((mix(words), mix(code + np.uint64(1 << 63)))) & np.uint64((1 << FEATURE_BITS) - 1)
    return np.concatenate((doc[start], doc[letter][own])), hashed.astype(np.int64)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """A logistic model over a few dense columns and many columns of zeros and ones, fitted with a ridge penalty."""

    def __init__(self, width: int, dense: int):
        self.weights = np.zeros(width)
        self.dense = np.zeros(dense)
        self.bias = 0.0

    def predict(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(row, weights=self.weights[column], minlength=len(dense)) + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 150) -> Logistic:
        n = len(y)
        if not n:
            self.bias = -30.0
            return self
        self.bias = float(log_odds(np.array((y.sum() + 0.5) / (n + 1))))
        state = np.concatenate((self.weights, self.dense, [self.bias]))
        mean, square = np.zeros_like(state), np.zeros_like(state)
        width = len(self.weights)
        for t in range(1, steps + 1):
            self.weights, self.dense, self.bias = state[:width], state[width:-1], float(state[-1])
            error = self.predict(row, column, dense) - y
            slope = np.concatenate((np.bincount(column, weights=error[row], minlength=width), dense.T @ error, [error.sum()])) / n
            slope[:-1] += ridge / n * state[:-1]
            mean = 0.9 * mean + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            step = 0.2 if t < steps * 2 // 3 else 0.05
            state = state - step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        self.weights, self.dense, self.bias = state[:width], state[width:-1], float(state[-1])
        return self


class Chain:
    """Models of the categories in order, and the column of each hashed feature (-1: not used)."""

    def __init__(self, categories: Sequence[str], column: np.ndarray, models: list[Logistic]):
        self.categories, self.column, self.models = list(categories), column, models

    def used(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each feature that occurs, once."""
        doc, feature = features(texts)
        column = self.column[feature]
        own = column >= 0
        width = int(self.column.max()) + 1
        key = np.unique(doc[own] * max(width, 1) + column[own])
        return key // max(width, 1), key % max(width, 1)

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        row, column = self.used(texts)
        out = np.zeros((len(texts), len(self.categories)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(row, column, log_odds(out[:, :k]))
        return out


def _telling(hits: np.ndarray, positive: np.ndarray, n: int, n_positive: int) -> np.ndarray:
    """How much each feature tells about a category: the log-likelihood ratio of the 2 x 2 table of texts."""

    def part(k: np.ndarray, of: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            p = k / of
            return np.nan_to_num(k * np.log(p)) + np.nan_to_num((of - k) * np.log(1 - p))

    rest, rest_positive = n - hits, n_positive - positive
    whole = part(np.full(len(hits), n_positive), np.full(len(hits), n))
    return part(positive, hits) + part(rest_positive, rest) - whole


def _tally(categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << FEATURE_BITS
        hits = np.zeros((2 * categories, size), dtype=np.int32)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                doc, feature = features(piece.column("_text"))
                key = np.unique((doc << FEATURE_BITS) | feature)
                doc, feature = key >> FEATURE_BITS, key & (size - 1)
                for k in range(categories):
                    y = piece.column(f"y{k}").to_numpy(zero_copy_only=False).astype(float)[doc]
                    hits[2 * k] += np.bincount(feature[~np.isnan(y)], minlength=size).astype(np.int32)
                    hits[2 * k + 1] += np.bincount(feature[y == 1], minlength=size).astype(np.int32)
        found = np.flatnonzero(hits.any(axis=0))
        for start in range(0, len(found), 50_000):
            own = found[start : start + 50_000]
            lists = pa.ListArray.from_arrays(
                np.arange(0, 2 * categories * len(own) + 1, 2 * categories, dtype=np.int32),
                pa.array(np.ascontiguousarray(hits[:, own].T).ravel().astype(np.int64)),
            )
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists], names=["feature", "hits"])

    return run


def _used(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                row, column = chain.used(piece.column("_text"))
                at = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(at, pa.array(column.astype(np.int32)))
                names = [c for c in piece.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), own], names=[*names, "used"])

    return run


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
        most_rows: int = MOST_ROWS) -> Chain:
    """The chain of ``categories``, which are columns of ``labels`` with 1, 0 or null (not labelled), joined by ``id_col``."""
    spark = tidy_arrow(docs.sparkSession)
    folder = scratch_folder(spark)
    marks = [F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *marks)
    # a bounded sample: its size is a parameter and not a share of the rows
    sample = known.orderBy(F.xxhash64("_id"), "_id", *[f"y{k}" for k in range(len(categories))]).limit(most_rows)
    ys = [f"y{k}" for k in range(len(categories))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = written(rows.select(F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("fold"), "_id", "_text", *ys), folder, "labelled")
    counts = rows.select(*[F.count(y) for y in ys], *[F.coalesce(F.sum(F.when(F.col(y) == 1, 1)), F.lit(0)) for y in ys]).first()
    tally = rows.select("_text", *ys).mapInArrow(_tally(len(ys)), "feature int, hits array<long>").groupBy("feature").agg(
        *[F.sum(F.col("hits")[i]).alias(f"h{i}") for i in range(2 * len(ys))]
    ).toArrow()  # at most 2**20 rows
    feature = tally["feature"].to_numpy()
    column = np.full(1 << FEATURE_BITS, -1, dtype=np.int64)
    chosen: set[int] = set()
    for k in range(len(ys)):
        hits, positive = tally[f"h{2 * k}"].to_numpy(), tally[f"h{2 * k + 1}"].to_numpy()
        score = _telling(hits, positive, counts[k], counts[len(ys) + k])
        best = np.lexsort((feature, -score))[:CHOSEN]
        chosen.update(feature[best[score[best] > 4]].tolist())
    ordered = np.array(sorted(chosen), dtype=np.int64)
    column[ordered] = np.arange(len(ordered))
    chain = Chain(categories, column, [])
    kinds = "fold int, " + ", ".join(f"{y} double" for y in ys) + ", used array<int>"
    # at most most_rows rows of at most the chosen features
    got = rows.select("fold", *ys, "_text").mapInArrow(_used(chain), kinds).toArrow()
    used = got["used"].combine_chunks()
    used = used if isinstance(used, pa.Array) else pa.concat_arrays(used.chunks)
    row = np.repeat(np.arange(len(used)), np.diff(used.offsets.to_numpy()))
    cols = used.values.to_numpy(zero_copy_only=False).astype(np.int64)
    fold = got["fold"].to_numpy()
    earlier = np.zeros((len(used), 0))
    for k, y_name in enumerate(ys):
        y = got[y_name].to_numpy().astype(float)
        known_y = ~np.isnan(y)

        def train(rows_in: np.ndarray, y=y, earlier=earlier) -> Logistic:
            number = np.cumsum(rows_in) - 1
            own = rows_in[row]
            return Logistic(len(ordered), earlier.shape[1]).fit(number[row[own]], cols[own], earlier[rows_in], y[rows_in])

        chain.models.append(train(known_y))
        out = np.zeros(len(used))
        for f in range(FOLDS):
            model = train(known_y & (fold != f))
            out = np.where(fold == f, model.predict(row, cols, earlier), out)
        earlier = np.column_stack((earlier, log_odds(out)))
    return chain


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, a probability ``p_<category>`` and a verdict ``<category>`` for each category; one row for each input row.

    Null and empty texts have no features and get what the models say of such a text; null ids and repeated rows are carried
    through; other columns are not read.
    """
    spark = tidy_arrow(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in pieces(batch, "_text"):
                p = own.predict(piece.column("_text"))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), *(pa.array(x) for x in p.T)], names=["_id", *names])

    kind = read.schema["_id"].dataType.simpleString()
    out = read.mapInArrow(run, f"_id {kind}, " + ", ".join(f"`{x}` double" for x in names))
    verdicts = [(F.col(f"p_{c}") >= threshold).alias(c) for c in chain.categories]
    return out.select(F.col("_id").alias(id_col), *names, *verdicts)
