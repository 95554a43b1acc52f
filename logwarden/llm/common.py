"""Scratch tables in the shared folder, row keys and batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once.  A longer document is taken alone and whole.
PIECE_BYTES = 1 << 20


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary folder is used where that is unset (local tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows starts from files and not from the lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy_arrow(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: documents are long, and a Python worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a 128-bit key ``_k1``, ``_k2`` of the named columns.

    Repeated rows have equal keys, and null columns have one too, so results are joined back by the key and not by an id
    that may be null or repeated.
    """
    there = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return docs.withColumns({"_k1": F.xxhash64(*there), "_k2": F.xxhash64(F.lit(1), *reversed(there))})


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column``, or one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)



def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches with about ``limit`` bytes in ``column``, whatever the sizes of those that came in; none is empty."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, column, limit):
            grown = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
            if held and size + grown > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(piece)
            size += grown
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
