"""Removal of passages that occur more than once: Rabin-Karp hashes of all fixed-length word windows, counted in Spark.

1. Each task takes chunks of documents and hashes every window.  Hashes that a chunk holds twice are settled there and
   sent on once, so a passage that a third of all documents share costs one entry a chunk; the others are sent once
   with the place they came from.  Entries travel as sorted, delta-coded blocks, one per (bucket of hashes, chunk).
2. Each bucket finds the hashes that came from two places and answers the chunks that asked.
3. Answers meet the chunk's list of documents and come back as window starts per document, which are joined to the
   texts.  Overlapping windows merge into maximal intervals, which are removed.

Hashes have as many bits as the number of windows asks for (see :func:`hash_bytes`), so that a false repeat anywhere in
the corpus has a probability below 1/500 at every size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import keyed, pieces, tidy_arrow
from logwarden.llm.words import split_words, window_hashes, window_starts, word_hashes

#: Bytes of text whose windows make up one bucket on average; it fixes the number of buckets, not what is kept.
BUCKET_BYTES = 6_000_000
CHUNK_BYTES = 4 << 20
SETTLED = 0xFFFFFFFF

_ENTRY = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.BinaryType()),
    T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("hashes", T.BinaryType()), T.StructField("rest", T.BinaryType()),
    T.StructField("places", T.BinaryType()),
])
_ARROW = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.binary()), ("kind", pa.string()), ("n", pa.int32()), ("hashes", pa.binary()),
    ("rest", pa.binary()), ("places", pa.binary()),
])


def hash_bytes(text_bytes: int) -> int:
    """Bytes of a window hash: twice the binary logarithm of the number of windows, and eight bits more."""
    windows = max(2, text_bytes // 4)
    return max(8, math.ceil((2 * math.log2(windows) + 8) / 8))


def planes(values: np.ndarray) -> bytes:
    """Little-endian numbers with equal bytes side by side, which compress well."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK_BYTES of text, whatever the sizes of those that came in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, "_text", CHUNK_BYTES):
            grown = sum(x or 0 for x in pc.binary_length(piece.column("_text")).to_pylist())
            if held and size + grown > CHUNK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(piece)
            size += grown
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ask(window: int, buckets: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(b for b in batches if b.num_rows):
            words = split_words(chunk.column("_text"))
            starts = window_starts(words, window)
            if not len(starts):
                continue
            k1 = chunk.column("_k1").to_numpy(zero_copy_only=False).astype(np.int64)
            k2 = chunk.column("_k2").to_numpy(zero_copy_only=False).astype(np.int64)
            first = window_hashes(word_hashes(words), starts, window)
            order = np.argsort(first, kind="stable")
            first = first[order]
            rest = None
            same = first[1:] == first[:-1]
            if wide > 8:
                rest = window_hashes(word_hashes(words, 1), starts, window, 1)[order] >> np.uint64(64 - 8 * min(8, wide - 8))
                if same.any():  # equal first halves stand in the order of the second
                    again = np.lexsort((rest, first))
                    first, rest, order = first[again], rest[again], order[again]
                same = (first[1:] == first[:-1]) & (rest[1:] == rest[:-1])
            # The name follows from the keys in their order, so a task that runs again says the same, and only chunks of
            # the same documents share one.
            name = hashlib.blake2b(np.stack((k1, k2)).tobytes(), digest_size=16).digest()
            places = starts[order].astype(np.uint32)
            head = np.concatenate(([True], ~same))
            runs = np.flatnonzero(head)
            many = np.diff(np.append(runs, len(head))) > 1
            twice = np.repeat(many, np.diff(np.append(runs, len(head))))
            sent = places[runs].copy()
            sent[many] = SETTLED
            first = first[runs]
            rest = rest[runs] if rest is not None else None
            # bucket = the top of the hash, scaled; so buckets are runs of the sorted hashes
            bucket = ((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            rows: dict[str, list] = {f.name: [] for f in _ARROW}

            def add(*values, rows=rows):
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)

            for b in used:
                part = slice(edges[b], edges[b + 1])
                steps = np.diff(first[part], prepend=np.uint64(0))
                tail = planes(rest[part]) if rest is not None else None
                add(int(b), name, "ask", edges[b + 1] - edges[b], planes(steps), tail, planes(sent[part]))
            home = int.from_bytes(name[:8], "little") % buckets
            docs = np.stack((k1, k2, words.first[:-1].astype(np.int64)), axis=1)
            add(home, name, "docs", len(docs), docs.tobytes(), None, None)
            settled = np.sort(places[twice])
            if len(settled):
                add(home, name, "found", len(settled), None, None, settled.tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    return run


def _answer(entries: pd.DataFrame) -> pd.DataFrame:
    """Places of one bucket whose hash came from another place too; lists of documents pass through."""
    through = entries[entries["kind"] != "ask"]
    asks = entries[entries["kind"] == "ask"]
    out = [through[["chunk", "kind", "hashes", "places"]]]
    if len(asks):
        hashes = np.concatenate([np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in asks["hashes"]])
        places = np.concatenate([unplanes(x, np.uint32) for x in asks["places"]])
        chunk = np.repeat(np.arange(len(asks)), asks["n"].to_numpy())
        if asks["rest"].iloc[0] is not None:
            rest = np.concatenate([unplanes(x, np.uint64) for x in asks["rest"]])
            order = np.lexsort((rest, hashes))
            rest, hashes = rest[order], hashes[order]
            same = (hashes[1:] == hashes[:-1]) & (rest[1:] == rest[:-1])
        else:
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            same = hashes[1:] == hashes[:-1]
        repeated = np.zeros(len(hashes), dtype=bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        hit = order[repeated]
        hit = np.sort(hit[places[hit] != SETTLED])
        ends = np.searchsorted(chunk[hit], np.arange(len(asks) + 1))
        names = asks["chunk"].to_numpy()
        found = [(names[i], "found", None, places[hit[ends[i] : ends[i + 1]]].tobytes())
                 for i in range(len(asks)) if ends[i] < ends[i + 1]]
        out.append(pd.DataFrame(found, columns=["chunk", "kind", "hashes", "places"]))
    return pd.concat([x for x in out if len(x)] or out[:1])


def _settle(answers: pd.DataFrame) -> pd.DataFrame:
    """Window starts per document of one chunk, counted from the document's first word."""
    lists = answers.loc[answers["kind"] == "docs", "hashes"]
    found = answers.loc[answers["kind"] == "found", "places"]
    rows = []
    if lists.nunique() > 1:
        raise ValueError("two chunks of different documents have one name")
    if len(lists) and len(found):
        docs = np.frombuffer(lists.iloc[0], np.int64).reshape(-1, 3)
        at = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in found])).astype(np.int64)
        ends = np.append(np.searchsorted(at, docs[:, 2]), len(at))
        # a document without words starts where the next one does, and so gets nothing
        for i in np.flatnonzero(np.diff(ends)):
            own = (at[ends[i] : ends[i + 1]] - docs[i, 2]).astype(np.uint32)
            rows.append((docs[i, 0], docs[i, 1], own.tobytes()))
    return pd.DataFrame(rows, columns=["_k1", "_k2", "_starts"])


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """``_k1, _k2, _starts``: for each of ``texts`` (``_k1, _k2, _text``) that has windows which occur twice anywhere, the
    words at which they start (uint32 binary)."""
    total = texts.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    buckets = min(1 << 30, max(1, math.ceil(total / BUCKET_BYTES)))
    asked = texts.select("_k1", "_k2", "_text").mapInArrow(_ask(window, buckets, hash_bytes(total)), _ENTRY)
    answers = asked.groupBy("bucket").applyInPandas(_answer, "chunk binary, kind string, hashes binary, places binary")
    return answers.groupBy("chunk").applyInPandas(_settle, "_k1 long, _k2 long, _starts binary").groupBy("_k1", "_k2").agg(
        F.min("_starts").alias("_starts")
    )


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) intervals of words that the windows cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > window)
    return np.append(starts[0], starts[gap + 1]), np.append(starts[gap], starts[-1]) + window


def _remove(window: int, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept, spans = [], [], [], []
            for text, found in zip(batch.column("_text"), batch.column("_starts"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n.append(len(words))
                starts = np.frombuffer(found.as_py() or b"", np.uint32).astype(np.int64)
                begin, end = intervals(starts, window)
                spans.append([{"start": s, "end": e} for s, e in zip(begin.tolist(), end.tolist(), strict=True)])
                removed.append(int((end - begin).sum()))
                stay, at = [], 0
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    stay += words[at:s]
                    at = e
                kept.append(b" ".join(stay + words[at:]).decode())
            columns = [batch.column(c) for c in passed] + [
                pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, "n_words", "n_removed", "kept_text", "removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which starts anywhere else too.

    Returns the columns ``carry`` (``id_col`` by default) with ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by
    one blank) and ``removed`` (maximal intervals of word numbers), one row for each input row.  Windows are judged on the
    input: of two copies both go.  Null and empty texts have no words and give an empty ``kept_text``; a null id is carried
    through; a repeated row is a document of its own, and so its windows are repeated.  Carried columns named like results
    are replaced.
    """
    tidy_arrow(docs.sparkSession)
    carried = [c for c in (carry or [id_col]) if c not in ("n_words", "n_removed", "kept_text", "removed")]
    inner = [f"_c{i}" for i in range(len(carried))]
    texts = docs.select(
        *(F.col(c).alias(x) for c, x in zip(carried, inner, strict=True)), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    texts = keyed(texts, "_id", "_text").drop("_id")
    found = repeated_windows(texts, window)
    joined = texts.join(found, ["_k1", "_k2"], "left").select(*inner, "_text", "_starts")
    kinds = "".join(f"{x} {joined.schema[x].dataType.simpleString()}, " for x in inner)
    schema = f"{kinds}n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>"
    out = joined.mapInArrow(_remove(window, inner), schema)
    return out.select(*(F.col(x).alias(c) for c, x in zip(carried, inner, strict=True)), "n_words", "n_removed", "kept_text", "removed")


def clean(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with all columns, repeated passages taken out of their texts and ``length_col``, if there is one, set anew.

    A text of which nothing is removed stays as it is, null included.
    """
    own = docs.columns
    plain = docs.toDF(*(f"_d{i}" for i in range(len(own))))
    ids, text = (f"_d{own.index(c)}" for c in (id_col, text_col))
    out = remove_repeats(plain, window, ids, text, plain.columns)
    changed = F.col("n_removed") > 0
    columns = {c: F.col(f"_d{i}") for i, c in enumerate(own)}
    columns[text_col] = F.when(changed, F.col("kept_text")).otherwise(F.col(text))
    if length_col in columns:
        columns[length_col] = F.when(changed, F.length("kept_text")).otherwise(columns[length_col]).cast(docs.schema[length_col].dataType)
    return out.select(*(x.alias(c) for c, x in columns.items()))
