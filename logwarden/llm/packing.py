"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Only lengths decide how documents are packed, and a length is at most the largest capacity: so Spark counts how many pieces
there are of each length, the plan is made from that histogram (at most one row per length, whatever the corpus holds),
and Spark gives the i-th piece of a length the i-th place that the plan has for it.  The plan is best-fit decreasing over
the whole corpus:

* pieces go by falling length into the open bin with the least room that still takes them;
* where none does, a bin is opened, of the size that costs least for each word it is going to hold, judged by filling it
  with the longest pieces that are still to come; a bin costs its capacity and ``overhead`` words more;
* at the end every bin shrinks to the smallest permitted capacity that holds its contents.

Bins in the same state are kept as one range of bins, so the plan's size depends on the number of lengths.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import keyed, scratch_folder, tidy_arrow, written
from logwarden.llm.words import WORD_PATTERN

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Pieces of one length that are numbered together, on average.
NUMBERED = 2_000


class Plan:
    """Where the pieces of each length go.

    A run sends the pieces of ``length`` from number ``first`` on, ``per`` to a bin, into the bins from ``bin`` on, from
    word ``used`` on.  A final range of bins has all its bins filled with ``filled`` words.
    """

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
        self.capacities = tuple(sorted(capacities))
        self.overhead = overhead
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first, per, bin, used
        self.bins = 0
        self._open: dict[int, list[tuple[int, int, int]]] = {}  # room -> (bin, how many, used)
        self._rooms: list[int] = []
        self._left = {n: c for n, c in counts.items() if c > 0}
        self._lengths = sorted(self._left)
        while self._lengths:
            length = self._lengths.pop()
            self._place(length, self._left.pop(length))
        ranges = sorted((b, n, used) for own in self._open.values() for b, n, used in own)
        self.first_bin = np.array([b for b, _, _ in ranges], dtype=np.int64)
        self.filled = np.array([used for _, _, used in ranges], dtype=np.int64)
        self.bin_count = np.array([n for _, n, _ in ranges], dtype=np.int64)
        self.runs.sort()

    def _put(self, room: int, bins: tuple[int, int, int]) -> None:
        if room not in self._open:
            insort(self._rooms, room)
        self._open.setdefault(room, []).append(bins)

    def _take(self, room: int) -> tuple[int, int, int]:
        own = self._open[room]
        bins = own.pop()
        if not own:
            del self._open[room]
            self._rooms.pop(bisect_left(self._rooms, room))
        return bins

    def _fill(self, capacity: int, length: int, count: int) -> int:
        """Words that a new bin would hold: ``length`` as often as it goes, then the longest pieces still to come."""
        filled = min(capacity // length, count) * length
        at = bisect_left(self._lengths, capacity - filled + 1) - 1
        while at >= 0 and filled < capacity:
            n = self._lengths[at]
            filled += min((capacity - filled) // n, self._left[n]) * n
            at = min(at, bisect_left(self._lengths, capacity - filled + 1)) - 1
        return filled

    def _cheapest(self, length: int, count: int) -> int:
        fit = [c for c in self.capacities if c >= length]
        return min(fit, key=lambda c: ((c + self.overhead) / self._fill(c, length, count), -c))

    def _place(self, length: int, count: int) -> None:
        first = 0
        while first < count:
            left = count - first
            at = bisect_left(self._rooms, length)
            if at < len(self._rooms):
                room = self._rooms[at]
                start, many, used = self._take(room)
            else:
                room = self._cheapest(length, left)
                start, many, used = self.bins, -(-left // (room // length)), 0
                self.bins += many
            per = min(room // length, left)
            full = min(many, left // per)
            self.runs.append((length, first, per, start, used))
            self._put(room - per * length, (start, full, used + per * length))
            first += per * full
            if full < many:
                self._put(room, (start + full, many - full, used))


def best_fit(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    return Plan(counts, capacities, overhead)


def _assign(plan: Plan, passed: list[str]):
    """Places of numbered pieces by binary search in the plan's runs."""
    wide = 48  # bits of a piece's number
    runs = np.array(plan.runs, dtype=np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << wide) | runs[:, 1]
    capacities = np.array(plan.capacities, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("piece_words").to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column("_number").to_numpy(zero_copy_only=False).astype(np.int64)
            own = runs[np.searchsorted(keys, (length << wide) | number, side="right") - 1]
            inside = number - own[:, 1]
            place = own[:, 3] + inside // own[:, 2]
            offset = own[:, 4] + inside % own[:, 2] * length
            filled = plan.filled[np.searchsorted(plan.first_bin, place, side="right") - 1]
            capacity = capacities[np.searchsorted(capacities, filled)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), pa.array(place), pa.array(offset), pa.array(capacity), pa.array(filled)],
                names=[*passed, "bin_id", "bin_offset", "capacity", "bin_words"],
            )

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of documents with their bins: ``id_col, n_words, piece, piece_start, piece_words, bin_id, bin_offset, capacity,
    bin_words``.

    Lengths are counted in words.  A document longer than the largest capacity is cut into pieces of that capacity and a
    rest; every other document is one piece.  Null texts and texts without words have one row without a bin.  Repeated
    rows are documents of their own; equal ids and null ids are allowed.  Other columns are not read.
    """
    spark = tidy_arrow(docs.sparkSession)
    most = max(capacities)
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_id", "_text").select(
        "_id", "_k1", F.regexp_count("_text", F.lit(WORD_PATTERN)).cast("long").alias("n_words")
    )
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_words") / most).cast("int") - 1, F.lit(0))))).select(
        "_id", "n_words", "_k1", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * most).alias("piece_start")
    ).withColumn("piece_words", F.least(F.col("n_words") - F.col("piece_start"), F.lit(most).cast("long")))
    # ids and lengths only; texts are read once
    cut = written(cut, scratch_folder(spark), "pieces")
    # at most one row for each length, which the largest capacity bounds
    counts = {r["piece_words"]: r["n"] for r in cut.where("piece_words > 0").groupBy("piece_words").agg(F.count("*").alias("n")).toLocalIterator()}
    plan = best_fit(counts, tuple(capacities), overhead)
    # a frequent length is numbered in parts, by the hash of the row; parts are numbered from where the last one ended
    parts = spark.createDataFrame([(n, -(-c // NUMBERED)) for n, c in counts.items()], "piece_words long, _parts long")
    cut = cut.join(F.broadcast(parts), "piece_words", "left").withColumn("_part", F.pmod(F.xxhash64("_k1", "piece"), F.col("_parts")))
    tally = cut.where("piece_words > 0").groupBy("piece_words", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("piece_words").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("piece_words", "_part").orderBy("_id", "_k1", "piece")
    numbered = cut.where("piece_words > 0").withColumn("_row", F.row_number().over(within) - 1).join(starts, ["piece_words", "_part"]).select(
        "_id", "n_words", "piece", "piece_start", "piece_words", (F.col("_start") + F.col("_row")).alias("_number")
    )
    names = ["_id", "n_words", "piece", "piece_start", "piece_words"]
    kinds = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in names)
    placed = numbered.mapInArrow(_assign(plan, names), f"{kinds}, bin_id long, bin_offset long, capacity long, bin_words long")
    empty = cut.where("piece_words = 0").select(*names, *(F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "capacity", "bin_words")))
    return placed.union(empty).withColumnRenamed("_id", id_col)


def bin_texts(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bin_id, capacity, bin_words, text``: the words of every bin in order, joined by one blank.

    For documents whose ids are unique.  A bin's pieces are gathered in one row; its capacity bounds them.
    """
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD_PATTERN})"))
    pieces = packed.where("bin_id IS NOT NULL").join(docs.select(id_col, words.alias("_words")), id_col)
    own = F.array_join(F.slice("_words", (F.col("piece_start") + 1).cast("int"), F.col("piece_words").cast("int")), " ")
    return pieces.groupBy("bin_id", "capacity", "bin_words").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin_offset", own.alias("t")))), lambda x: x["t"]), " ").alias("text")
    )
