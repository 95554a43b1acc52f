"""Streaming jobs.

Verdicts, normalization and parsing are projections: apply the batch operator
to a stream and start it with :func:`append_stream`.  What needs state is here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from logwarden.functions.times import micros
from logwarden.operators import correlate as C
from logwarden.operators import dedup as D
from logwarden.operators import windowed as X
from logwarden.operators import windows as W

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_stream(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write a stream to a parquet table, exactly once per input row."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def each_batch(df: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Run a batch operator on every micro-batch and store its result.

    The result of a batch replaces what an earlier attempt of the same batch
    has written, so a restart adds nothing twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        out = job(batch).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------------------
# Suppression of repeated alerts
# ---------------------------------------------------------------------------


class _Suppressor(StatefulProcessor):
    """Anchor, number of dropped rows and time of the last row per fingerprint.

    With ``expire`` a fingerprint that was idle for more than one window starts
    anew, and a row without id tells how many were dropped since its last one
    that passed: when the watermark says so, or at the latest when it comes back.
    """

    def __init__(self, window_us: int, expire: bool):
        self.window_us, self.expire = window_us, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("anchor", "anchor_us long, dropped long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = None
        for part in rows:  # only instants are kept, not rows
            part = part[["us", "id"]].assign(n=1)
            seen = (part if seen is None else pd.concat([seen, part])).groupby("us", as_index=False).agg({"id": "min", "n": "sum"})
        us, ident, n = seen["us"].to_numpy(), seen["id"].to_numpy(), seen["n"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(n)])
        anchor, dropped, last = self.state.get() if self.state.exists() else (None, 0, None)
        out, at = [], 0
        while at < len(us):
            count = 0
            if anchor is not None:
                following = max(at, int(np.searchsorted(us, anchor + self.window_us)))
                dropped += int(sums[following] - sums[at])
                if following > at:
                    last = max(last, int(us[following - 1]))
                at = following
                if at == len(us):
                    break
                if self.expire and us[at] - last > self.window_us:
                    out += _dropped(key, last, dropped)
                else:
                    count = dropped + 1
            out.append((key[0], int(us[at]), int(ident[at]), count))
            anchor = last = int(us[at])
            dropped = int(n[at]) - 1
            at += 1
        self.state.update((anchor, dropped, last))
        if self.expire:
            self.handle.registerTimer((last + self.window_us) // 1000 + 1)
        yield _passed(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            _, dropped, last = self.state.get()
            if (last + self.window_us) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                out = _dropped(key, last, dropped)
                self.state.clear()
        yield _passed(out)

    def close(self) -> None:
        pass


def _dropped(key: tuple, last: int, dropped: int) -> list[tuple]:
    return [(key[0], last, None, dropped)] if dropped else []


def _passed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["fp", "us", "id", "duplicate_count"]).astype(
        {"fp": object, "us": "int64", "id": "Int64", "duplicate_count": "int64"})


def suppress_stream(df: DataFrame, id_col: str = "id", ts_col: str = "ts", delay: str = "1 minute",
                    window_seconds: int = D.SUPPRESS_SECONDS, expire: bool = False) -> DataFrame:
    """Passing alerts of a stream: fp, us, id, duplicate_count.

    Event time decides; rows of one micro-batch are put in time order.
    ``expire`` drops fingerprints idle for more than one window: the next row
    passes with count 0, and a row with null id, the time of the last row and
    the number dropped tells what was pending.
    Needs the RocksDB state store (:data:`ROCKSDB`).
    """
    keyed = df.filter(~D.is_bypassed(df)).select(
        D.fingerprint(df).alias("fp"), micros(ts_col).alias("us"), F.col(id_col).cast("bigint").alias("id"),
        F.col(ts_col).alias("ts"))
    return suppress_keyed_stream(keyed, delay, window_seconds, expire)


def suppress_keyed_stream(keyed: DataFrame, delay: str = "1 minute", window_seconds: int = D.SUPPRESS_SECONDS,
                          expire: bool = False) -> DataFrame:
    """:func:`suppress_stream` of rows that have their own key: fp, us, id, ts."""
    return keyed.withWatermark("ts", delay).groupBy("fp").transformWithStateInPandas(
        statefulProcessor=_Suppressor(window_seconds * 1_000_000, expire),
        outputStructType="fp string, us long, id long, duplicate_count long",
        outputMode="Append", timeMode="EventTime" if expire else "None",
    )


def suppress_stream_uncounted(df: DataFrame, ts_col: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Built-in variant without counts: one row per fingerprint and watermark span."""
    keyed = df.withColumn("fp", D.fingerprint(df)).withWatermark(ts_col, window)
    return keyed.dropDuplicatesWithinWatermark(["fp"])


# ---------------------------------------------------------------------------
# Window verdicts
# ---------------------------------------------------------------------------


def window_rows_stream(inputs: DataFrame, delay: str = "10 seconds", seconds: int = W.WINDOW_SECONDS) -> DataFrame:
    """Rows of closed windows of a stream without repeated alerts, one row each: no window is gathered in state."""
    stamped = W.assign_windows(inputs.withWatermark("ts", delay), seconds)
    names = [c for c in inputs.columns if c not in ("source_type",)]
    same = [F.coalesce(F.col(c), F.lit("")).alias(f"__i{i}") for i, c in enumerate(W._IDENTITY)]
    first = stamped.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "source_type", *same).agg(
        F.min(F.struct("ts", "source_event_id", *[c for c in names if c not in ("ts", "source_event_id")])).alias("r")
    )
    return first.select(F.col("w.start").alias("window_ts"), "source_type", "r.*", F.lit("").alias("fingerprint"))


def pass_rows_stream(inputs: DataFrame, path: str, checkpoint: str, delay: str = "10 seconds",
                     trigger: dict | None = None) -> StreamingQuery:
    """Verdict rows of closed windows, written batch by batch.  A window closes as a whole, so one batch has all its rows."""
    return each_batch(window_rows_stream(inputs, delay), W.rule_pass_rows, path, checkpoint, trigger)


# ---------------------------------------------------------------------------
# Correlation
# ---------------------------------------------------------------------------


def correlate_stream(endpoint: DataFrame, firewall: DataFrame, delay: str = "2 minutes", mode: str = "intent",
                     salt: int = 1) -> DataFrame:
    """Matches of the four pair rules on two streams in the common event shape, one row for each pair of rows.

    An inner join of two streams with watermarks and a time range: a row is
    kept for ten minutes and the delay.  The fifth rule, brute force, keeps its
    own state: :func:`logwarden.streaming.bursts.brute_force_stream`.
    """
    return C.pair_matches(
        endpoint.withWatermark("ts", delay), firewall.withWatermark("ts", delay), None, None, mode, salt
    )


# ---------------------------------------------------------------------------
# Work on closed windows of a table
# ---------------------------------------------------------------------------


def run_closed_windows(
    spark: SparkSession,
    events: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    ledger_path: str,
    out_path: str,
    now: dt.datetime,
    minutes: int = X.WINDOW_MINUTES,
    ts_col: str = "ts",
    lookback: int = 0,
    engine: str = X.ENGINE,
    lease: int = X.LEASE_SECONDS,
) -> None:
    """Run ``job`` over every closed window that is open (see :func:`logwarden.operators.windowed.open_windows`).

    All open windows are handled by one job over their rows, not one by one.
    ``job`` gets the rows with window_start and returns rows with window_start;
    its result replaces the partitions of those windows, so a window that is
    worked on twice has its rows once.  A failed run is noted in the ledger and
    its windows are open again; those of a run that died are open after ``lease``
    seconds.  ``lookback`` seconds of earlier rows come along (column
    ``in_window`` is false for them).
    """
    import uuid

    from logwarden.sources.sinks import append_rows, replace_windows

    schema = ("engine_name string, window_start timestamp, window_end timestamp, status string, recorded_at timestamp, "
              "run string, error_text string")

    def ledger() -> DataFrame:
        try:
            found = spark.read.schema(schema).parquet(ledger_path)
            found.take(1)
            return found
        except Exception as error:  # the first run has no ledger
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schema)

    run, stamp = uuid.uuid4().hex, F.lit(now).cast("timestamp")
    end = F.lit(X.last_closed_window(now, minutes)[1]).cast("timestamp")
    staged = X.in_windows(events.withColumn("ts", F.col(ts_col).cast("timestamp")), "ts", minutes)
    closed = staged.filter(F.col("window_end") <= end)
    append_rows(X.claim_rows(X.open_windows(closed, ledger(), stamp, lease, engine), stamp, engine, run), ledger_path)
    # Two runs can claim the same window; the ledger says who was first.
    todo = X.won_windows(ledger(), run, stamp, lease, engine)
    span = todo.agg(F.min("window_start").alias("first"), F.max("window_end").alias("last")).first()
    if span["first"] is None:
        return
    try:
        # The outer range is a literal, so that day partitions are pruned.
        there = F.col("ts").between(F.lit(span["first"] - dt.timedelta(seconds=lookback)), F.lit(span["last"]))
        rows = staged.filter(there) if lookback else staged.filter(there).join(todo, ["window_start", "window_end"], "left_semi")
        if lookback:
            marked = todo.select("window_start", F.lit(True).alias("in_window"))
            rows = rows.join(marked, "window_start", "left").fillna(False, ["in_window"])
        replace_windows(job(rows), out_path)
    except Exception as error:
        append_rows(X.failure_rows(todo, stamp, F.lit(str(error)), engine, run), ledger_path)
        raise
    append_rows(X.ledger_rows(todo, "done", stamp, engine, run), ledger_path)
