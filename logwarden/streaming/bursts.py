"""Brute force on two streams: failed logons and blocked connections meet in the state of their source address.

The state of a source holds instants of the last ten minutes (blocks: twenty)
and the running sums of one open burst, so it does not grow with the length of
an attack.  Nothing is decided before the watermark has passed: an instant is
judged once all rows up to it have come, a burst ends once no row can extend it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logwarden.functions.times import micros
from logwarden.operators import correlate as C

_ROW = ["blocked", "us", "n", "id", "host"]
_FOUND = "key string, host string, failures long, first_us long, last_us long, blocks long, f_min long, f_max long"
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]
_PACK = pa.schema([("blocked", pa.bool_()), ("us", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("host", pa.string())])
#: Instants in one entry of the state, which is read and written entry by entry.
PACK_ROWS = 10_000
#: Rows that come in are reduced to instants when so many wait, or as many as there are instants.
WAITING_ROWS = 100_000


def _instants(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each instant of failures and of blocks, in time order; ``host`` is that of the smallest id."""
    ordered = rows.sort_values(["blocked", "us", "id"], kind="stable")
    first = ordered.drop_duplicates(["blocked", "us"]).reset_index(drop=True)
    first["n"] = ordered.groupby(["blocked", "us"])["n"].sum().to_numpy()
    return first[_ROW]


class _Burst:
    """Sums of one burst: ``failures`` counts up to ``last``, its newest row with enough failures before it."""

    def __init__(self, first: int, last: int, failures: int, host: str | None):
        self.first, self.last, self.failures, self.host = first, last, failures, host

    def state(self) -> tuple:
        return self.first, self.last, self.failures, self.host


class _BurstFinder(StatefulProcessor):
    def __init__(self, minimum: int, width: int):
        self.minimum, self.width = minimum, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.open = handle.getValueState("open", "first long, last long, failures long, host string")
        self.judged = handle.getValueState("judged", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come, waiting = _unpacked([]), []
        for part in rows:
            waiting.append(part[_ROW])
            if sum(map(len, waiting)) >= max(WAITING_ROWS, len(come)):
                come, waiting = _instants(pd.concat([come, *waiting])), []
        come = _instants(pd.concat([come, *waiting])) if waiting else come
        if len(come):
            self.rows.appendList(_packed(come))
            newest = int(come["us"].max())
            for wait in (self.width, 2 * self.width):  # a burst can end then; its blocks are needed no longer
                self.handle.registerTimer((newest + wait) // 1000 + 1)
        yield _found([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = _instants(_unpacked(self.rows.get() if self.rows.exists() else []))
        failed, blocks = known[~known["blocked"]], known[known["blocked"]]
        before = self.judged.get()[0] if self.judged.exists() else None
        burst = _Burst(*self.open.get()) if self.open.exists() else None
        ended, burst = self._judge(failed[failed["us"] <= now], before, burst)
        if burst is not None and burst.last + self.width <= now:
            ended, burst = [*ended, burst], None
        yield _found([row for b in ended for row in self._confirmed(key[0], b, blocks)])

        stay = (failed["us"] > now - self.width), (blocks["us"] > now - 2 * self.width)
        if burst is not None:
            stay = stay[0], stay[1] | blocks["us"].between(burst.first - self.width, burst.first + self.width)
        left = pd.concat([failed[stay[0]], blocks[stay[1]]])
        if len(left) or burst is not None:
            self.rows.put(_packed(left))
            self.judged.update((now,))
        else:
            self.rows.clear()
            self.judged.clear()
        if burst is not None:
            self.open.update(burst.state())
        else:
            self.open.clear()

    def _judge(self, failed: pd.DataFrame, before: int | None, burst: _Burst | None) -> tuple[list[_Burst], _Burst | None]:
        """Bursts that later rows cannot extend, and the open one."""
        us, host = failed["us"].to_numpy(), failed["host"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(failed["n"].to_numpy(dtype=np.int64))])
        low = np.searchsorted(us, us - self.width)
        hot = np.flatnonzero((sums[1:] - sums[low] >= self.minimum) & (True if before is None else us > before))
        ended: list[_Burst] = []
        if not len(hot):
            return ended, burst
        for island in np.split(hot, np.flatnonzero(np.diff(us[hot]) >= self.width) + 1):
            start, end = island[0], island[-1]
            if burst is not None and us[start] - burst.last < self.width:
                burst.failures += int(sums[end + 1] - sums[np.searchsorted(us, burst.last, side="right")])
                burst.last = int(us[end])
                continue
            if burst is not None:
                ended.append(burst)
            first = low[start]
            burst = _Burst(int(us[first]), int(us[end]), int(sums[end + 1] - sums[first]), host[first])
        return ended, burst

    def _confirmed(self, key: str, burst: _Burst, blocks: pd.DataFrame) -> Iterator[tuple]:
        near = blocks[blocks["us"].between(burst.first - self.width, burst.first + self.width)]
        if len(near):
            yield (key, burst.host, burst.failures, burst.first, burst.last, int(near["n"].sum()),
                   int(near["us"].min()), int(near["us"].max()))

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Entries of the state, each an Arrow stream of some instants."""
    out = []
    for start in range(0, len(rows), PACK_ROWS):
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows[_ROW].iloc[start:start + PACK_ROWS], schema=_PACK, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(entries: Iterable[tuple[bytes]]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(e[0])).read_all() for e in entries]
    return pa.concat_tables([_PACK.empty_table(), *tables]).to_pandas()[_ROW]


def _found(rows: list[tuple]) -> pd.DataFrame:
    types = {c: "int64" for c in _COLUMNS if c not in ("key", "host")}
    return pd.DataFrame(rows, columns=_COLUMNS).astype({**types, "key": object, "host": object})


def brute_force_stream(endpoint: DataFrame, firewall: DataFrame, delay: str = "2 minutes",
                       minimum: int = C.MIN_FAILURES, window: int = C.WINDOW_SECONDS) -> DataFrame:
    """Brute-force incidents of two streams in the common event shape, as :func:`correlate.brute_force` gives for tables.

    An incident leaves when the watermark is ``window`` seconds past the burst's
    last row.  Rows later than ``delay`` are dropped by Spark; rows without a
    time or an address take no part.  Needs the RocksDB state store.
    """
    def side(rows: DataFrame, blocked: bool) -> DataFrame:
        host = F.lit(None).cast("string") if blocked else F.col("agent_host")
        return rows.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
            F.col("src_ip").alias("key"), F.lit(blocked).alias("blocked"), micros("ts").alias("us"),
            F.lit(1).cast("bigint").alias("n"), F.col("id").cast("bigint").alias("id"), host.alias("host"), "ts")

    both = side(C.failures(endpoint), False).unionByName(side(C.guessing_blocks(firewall), True))
    found = both.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_BurstFinder(minimum, window * 1_000_000), outputStructType=_FOUND, outputMode="Append",
        timeMode="EventTime",
    )
    return C.burst_incidents(found)
