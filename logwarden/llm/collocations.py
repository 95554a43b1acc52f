"""Collocations of two to five words by the stripes pattern: each prefix keys an associative counter of its next words.

Level k has the stripes of all prefixes of k - 1 words; level 1 is the stripe of the empty prefix.  A task counts a chunk
of text, sends one stripe for each (language, prefix, part) of a chunk, and stripes of one key are merged element by
element.  One structure then tells all that scores ask for: an entry is the count of an extension, the entry of a prefix in
the stripe above is its total, and the largest entry of a stripe says whether an extension subsumes it.

Nearly all phrases are rare, and stripes of rare ones would be most of the work.  So hashes of phrases are counted first,
level by level: a hash is a number, and no phrase of k words is more frequent than its two parts of k - 1 words, so level k
looks only at places whose parts are frequent.  Frequent hashes are kept in bitmaps of bounded size (``MOST_BITS``).  Where
phrases share a hash or a bit, more stripes are sent than needed and nothing is lost, since stripes are keyed by words.

The stripe of a frequent prefix would be one task's work, so stripes are cut into ``PARTS`` by the hash of the next word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import chunks, scratch_folder, tidy_arrow, written
from logwarden.llm.words import mix, rolling, text_bytes

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Bytes of text whose phrases are counted together before anything is sent.
CHUNK_BYTES = 3 << 20
PARTS = 64
#: Bits of a counted hash beyond those that tell as many phrases as the text has bytes.
SPARE_BITS = 4
#: Bits of a bitmap of frequent phrases: sixteen a phrase, and 32 MB at most.
BITS_PER_PHRASE, MOST_BITS = 16, 1 << 28
#: Bits of one row of Spark's bitmap functions.
_BITMAP = 32768

#: Entries that a task merges before it sends them.
MOST_ENTRIES = 1_000_000
_ENTRY = ["lang", "prefix", "part", "word", "n"]

_BYTE_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True

_STRIPE = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("stripe", T.MapType(T.StringType(), T.LongType())),
])


class Tokens(NamedTuple):
    word: np.ndarray  #: number of each word in ``words``
    piece: np.ndarray  #: number of the piece that the word lies in
    doc: np.ndarray  #: number of the document
    words: pa.Array  #: the different words (binary)
    hashes: np.ndarray  #: a hash of each different word


def _hashes(words: pa.Array) -> np.ndarray:
    data, at = text_bytes(words.cast(pa.string()))
    return rolling(data.astype(np.uint64) + np.uint64(1), at[:-1], at[1:], _BYTE_BASE)


def tokens(column: pa.Array) -> Tokens:
    """Words of a text column with A-Z in lower case; ``[.,;:!?\\x0A-\\x0D]`` end pieces, blanks and tabs end words."""
    data, at = text_bytes(column)
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    inside = ~_GAP[data]
    edge = at[:-1][at[:-1] < at[1:]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    ends = np.append(inside[:-1] & ~inside[1:], inside[-1:])
    ends[edge[1:] - 1] = inside[edge[1:] - 1]
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    # breaks before a word never get fewer and documents get more, so the sum changes exactly where a piece does
    piece = np.cumsum(_BREAK[data])[start] + doc if len(start) else start
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=offsets[1:])
    flat = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    coded = flat.dictionary_encode()
    return Tokens(coded.indices.to_numpy().astype(np.int64), piece, doc, coded.dictionary, _hashes(coded.dictionary))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Level(NamedTuple):
    """The different phrases of a length in a chunk; a phrase is a prefix of the level below and a word."""

    prefix: np.ndarray  #: number of the prefix, which is the number of the language at level 1
    last: np.ndarray  #: number of the last word
    count: np.ndarray
    first: np.ndarray  #: one place of the phrase
    hashes: np.ndarray


def levels(t: Tokens, lang: np.ndarray, lang_hashes: np.ndarray, bitmaps: list[np.ndarray], longest: int) -> Iterator[Level]:
    """Phrases of 1 to ``longest`` words; from level k on only places are followed whose phrase is in ``bitmaps[k - 1]``."""
    places = np.arange(len(t.word))
    above, hashes = lang[t.doc], lang_hashes
    for k in range(1, longest + 1):
        number, different = pd.factorize((above << 32) | t.word[places + k - 1])
        first = np.zeros(len(different), dtype=np.int64)
        first[number[::-1]] = places[::-1]
        prefix, last = different >> 32, different & 0xFFFFFFFF
        hashes = mix(hashes[prefix] * _STEP + t.hashes[last])
        yield Level(prefix, last, np.bincount(number, minlength=len(different)), first, hashes)
        if k == longest:
            return
        alive = np.full(len(t.word) + 1, -1, dtype=np.int64)
        alive[places] = np.where(_has(bitmaps[k - 1], hashes)[number], number, -1) if k <= len(bitmaps) else number
        head = np.flatnonzero((alive[:-1] >= 0) & (alive[1:] >= 0))
        head = head[head + k < len(t.word)]
        places = head[t.piece[head] == t.piece[head + k]]
        above = alive[places]


def _opened(chunk: pa.RecordBatch) -> tuple[Tokens, pa.Array, np.ndarray, np.ndarray]:
    root = chunk.column("_lang").dictionary_encode()
    return tokens(chunk.column("_text")), root.dictionary, root.indices.to_numpy().astype(np.int64), _hashes(root.dictionary)


def chunk_entries(chunk: pa.RecordBatch, bitmaps: list[np.ndarray], longest: int) -> pa.Table:
    """Entries of the stripes of one chunk, of the phrases whose hash is in the bitmap of their level, if it has one."""
    t, names, lang, lang_hashes = _opened(chunk)
    out = []
    for k, level in enumerate(levels(t, lang, lang_hashes, bitmaps, longest), 1):
        kept = np.flatnonzero(_has(bitmaps[k - 1], level.hashes)) if k <= len(bitmaps) else np.arange(len(level.last))
        last, at = level.last[kept], level.first[kept]
        words = [t.words.take(pa.array(t.word[at + i])) for i in range(k - 1)]
        prefix = pc.binary_join_element_wise(*words, b" ").cast(pa.string()) if words else pa.array([""] * len(at), pa.string())
        part = (t.hashes[last] % np.uint64(PARTS)).astype(np.int32)
        out.append([names.take(pa.array(lang[t.doc[at]])), prefix, pa.array(part), t.words.take(pa.array(last)).cast(pa.string()), pa.array(level.count[kept])])
    # the number of all words of a language is the entry of the empty word, which no text has
    total = np.bincount(lang[t.doc], minlength=len(names))
    nothing = pa.array([""] * len(total), pa.string())
    out.append([names, nothing, pa.array(np.zeros(len(total), np.int32)), nothing, pa.array(total)])
    return pa.concat_tables([pa.Table.from_arrays(x, names=_ENTRY) for x in out])


def as_stripes(entries: pa.Table) -> pa.RecordBatch:
    """One row for each (language, prefix, part), with its associative counter."""
    entries = entries.sort_by([(c, "ascending") for c in _ENTRY[:3]]).combine_chunks()
    keys = [entries.column(c) for c in _ENTRY[:3]]
    changes = [pc.not_equal(x.slice(1), x.slice(0, max(0, len(x) - 1))).to_numpy() for x in keys]
    heads = np.append(0, np.flatnonzero(changes[0] | changes[1] | changes[2]) + 1) if len(entries) else np.zeros(0, np.int64)
    word, count = (entries.column(c).combine_chunks() for c in _ENTRY[3:])
    stripe = pa.MapArray.from_arrays(pa.array(np.append(heads, len(entries)).astype(np.int32)), word, count)
    return pa.RecordBatch.from_arrays([*(x.combine_chunks().take(pa.array(heads)) for x in keys), stripe], names=_STRIPE.fieldNames())


def _stripes(bitmaps: list, longest: int):
    """Stripes of a task; those of its chunks are merged before they leave, and leave before they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for chunk in chunks(batches, "_text", CHUNK_BYTES):
            held.append(chunk_entries(chunk, [b.value for b in bitmaps], longest))
            rows += len(held[-1])
            if rows > MOST_ENTRIES:
                held = [_merged(held)]
                rows = len(held[0])
                if rows > MOST_ENTRIES // 2:
                    yield from _sent(held)
                    held, rows = [], 0
        if held:
            yield from _sent([_merged(held)])

    return run


def _merged(tables: list[pa.Table]) -> pa.Table:
    every = pa.concat_tables(tables).group_by(_ENTRY[:4], use_threads=False).aggregate([("n", "sum")])
    return every.rename_columns({"n_sum": "n"}).select(_ENTRY)


def _sent(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    out = as_stripes(tables[0])
    return (out.slice(i, 20_000) for i in range(0, out.num_rows, 20_000))


def _slots(bitmaps: list, bits: int):
    """Hashes of the phrases of level ``len(bitmaps) + 1``, cut to ``bits`` bits, with their counts in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_BYTES):
            t, _, lang, lang_hashes = _opened(chunk)
            for level in levels(t, lang, lang_hashes, [b.value for b in bitmaps], len(bitmaps) + 1):
                pass
            slot = (level.hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(slot), pa.array(level.count)], names=["slot", "c"])
            yield from (out.slice(i, 100_000) for i in range(0, out.num_rows, 100_000))

    return run


def bitmap(slots: DataFrame) -> np.ndarray:
    """The bitmap of a column of hashes ``slot``, little-endian: at most ``MOST_BITS / 8`` bytes reach the driver."""
    n = slots.count()
    bits = min(MOST_BITS, max(_BITMAP, 1 << (BITS_PER_PHRASE * n).bit_length()))
    place = F.col("slot").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    rows = slots.groupBy(F.call_function("bitmap_bucket_number", place).alias("bucket")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("bits")
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows.toLocalIterator():
        at = (row["bucket"] - 1) * _BITMAP // 8
        out[at : at + _BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))


def frequent(docs: DataFrame, folder: str, least: int = LEAST, longest: int = LONGEST, text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Entries ``lang, prefix, word, n, phrase`` of all stripes with ``n >= least``, a written table.

    For each language there is an entry of the empty word too: the number of all its words.
    """
    spark = tidy_arrow(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text_col).alias("_text"))
    texts = texts.where("_text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    bits = min(62, max(16, size.bit_length() + SPARE_BITS))
    bitmaps: list = []
    for k in range(1, longest):
        slots = texts.mapInArrow(_slots(bitmaps, bits), "slot long, c long").groupBy("slot").agg(F.sum("c").alias("n"))
        often = written(slots.where(F.col("n") >= least).select("slot"), folder, f"slots-{k}")
        bitmaps.append(spark.sparkContext.broadcast(bitmap(often)))
    stripes = texts.mapInArrow(_stripes(bitmaps, longest), _STRIPE).repartition("lang", "prefix", "part")
    entries = stripes.select("lang", "prefix", "part", F.explode("stripe").alias("word", "c"))
    merged = entries.groupBy("lang", "prefix", "part", "word").agg(F.sum("c").alias("n"))
    kept = merged.where((F.col("n") >= least) | (F.col("word") == ""))
    return written(kept.select("lang", "prefix", "word", "n", _phrase().alias("phrase")), folder, "entries")


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text",
         lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``, and ``cut``.

    A phrase of 2 to ``longest`` words that occurs ``a >= least`` times is cut where ``floor(1000 * a * n / (l * r))`` is
    least (the first such cut): ``l`` and ``r`` are the counts of its two parts, ``n`` that of all words of the language.
    A phrase that lies inside a longer candidate with as many occurrences is dropped: then, as counts only fall with
    length, it lies inside one that is longer by one word, which is the largest entry of its own stripe or ends with it.
    Products are decimals of 38 digits, exact up to 1e17 words.

    A null language is ``und``, a null or empty text has no words, repeated rows count as often as they occur, ties go to
    the larger count and then to the smaller phrase in byte order; other columns are not read, and an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    entries = frequent(docs, folder, least, longest, text_col, lang_col)
    sizes = entries.where("word = ''").select("lang", F.col("n").alias("size"))
    every = entries.where("word <> ''").select("lang", "prefix", "phrase", "n")
    words = F.split("phrase", " ")
    candidates = every.where("prefix <> ''")
    longer = candidates.select("lang", F.col("prefix").alias("phrase"), "n").unionByName(
        candidates.select("lang", F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ").alias("phrase"), "n")
    ).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut")
    cuts = candidates.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n").select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("words"), cut
    ).withColumns({
        "first": F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "),
        "rest": F.array_join(F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")), " "),
    }).drop("words")
    counts = every.select("lang", "phrase", "n")
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    parts = parts.join(sizes.withColumnRenamed("size", "n"), "lang")
    product = (F.lit(1000).cast("decimal(4,0)") * (_whole(F.col("a")) * _whole(F.col("n")))).cast("decimal(38,0)")
    parts = parts.withColumn("top", product).withColumn("below", _whole(F.col("l")) * _whole(F.col("r")))
    scored = parts.withColumn("score", F.expr("top div below")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("least")
    ).select("lang", "phrase", "least.*")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task sorts a whole one
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    few = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
