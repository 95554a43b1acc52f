"""Play a table as a stream: slices in time order, each a run of the query that goes on from the last checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.streaming.jobs import ROCKSDB, append_stream


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset, as on a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="replay-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/replay-{uuid.uuid4().hex}"


def replay(spark: SparkSession, tables: dict[str, DataFrame], build: Callable[..., DataFrame], slices: int = 3,
           closing: dict[str, DataFrame | Callable[[DataFrame], DataFrame]] | None = None, folder: str | None = None) -> DataFrame:
    """What ``build(**streams)`` has written after all rows of ``tables`` (column ``ts``) came in time order.

    The span of times is cut into ``slices`` equal parts; rows of one part come
    together and in no order.  Every part is a new run on the same checkpoint,
    so the state goes through the store.  ``closing`` rows come last, to move
    the watermark past all others; a function makes them of the written rows.
    """
    folder = folder or shared_folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    staged = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/staged/{name}")
        staged[name] = spark.read.schema(rows.schema).parquet(f"{folder}/staged/{name}")
    spans = [t.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first() for t in staged.values()]
    low = min((s["low"] for s in spans if s["low"] is not None), default=None)
    high = max((s["high"] for s in spans if s["high"] is not None), default=None)
    edges = [] if low is None else [low + (high - low) * k / slices for k in range(1, slices)]

    def part(rows: DataFrame, k: int) -> DataFrame:
        if k == slices:
            return rows
        after = F.lit(True) if k == 0 else F.col("ts") > F.lit(edges[k - 1])
        return rows.filter(after & (F.lit(True) if k == slices - 1 else F.col("ts") <= F.lit(edges[k])))

    for k in range(0 if low is None else slices + bool(closing)):
        for name, rows in (staged if k < slices else closing).items():
            rows = rows(staged[name]) if callable(rows) else rows
            part(rows, k).select(*staged[name].columns).write.mode("append").parquet(f"{folder}/in/{name}")
        streams = {n: spark.readStream.schema(t.schema).parquet(f"{folder}/in/{n}") for n, t in staged.items()}
        running = append_stream(build(**streams), f"{folder}/out", f"{folder}/checkpoint")
        running.awaitTermination()
    out = build(**{n: spark.readStream.schema(t.schema).parquet(f"{folder}/staged/{n}") for n, t in staged.items()}).schema
    return spark.read.schema(out).parquet(f"{folder}/out") if low is not None else spark.createDataFrame([], out)
