"""Language ID by bit-sliced Bloom filters over character n-grams.

Every learned language owns one bit position.  A slot of the filter is a word with one bit per language, so the AND of an
n-gram's slots is the set of all languages that hold the n-gram.  A text adds up, language by language, how many of its
n-grams have the bit set, takes off what false positives alone would give, and decides for the largest share.

A language holds an n-gram that makes up at least ``FLOOR`` of its n-grams of that length and is at least ``KEEN`` times
as frequent there as in the language where it is most frequent.  So a language holds at most ``1 / FLOOR`` n-grams of a
length however large the corpus is, and the filter has a fixed size: 16 MB for each 64 languages.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import pieces, remove_folder, scratch_folder, tidy_arrow, written
from logwarden.llm.words import mix, sums, text_bytes

LENGTHS = (3, 4)
FLOOR = 1e-5
KEEN = 0.1
SLOT_BITS = 21
HASHES = 4
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter (general category L)."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[place].astype(np.int32)
    padded = np.append(data, [0, 0, 0]).astype(np.int32) & 0x3F
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        own = np.flatnonzero((out >= least) & (out < most) & (data[place] >= least))
        value = out[own] & mask
        for k in range(1, more + 1):
            value = (value << 6) | padded[place[own] + k]
        out[own] = value
    return out, place


def letter_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 before each run of them, and where each document begins; a last 0 closes all."""
    data, at = text_bytes(pc.utf8_lower(column.fill_null("")))
    point, place = code_points(data)
    letter = letter_table()[point]
    first = np.searchsorted(place, at)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edge = first[:-1][first[:-1] < first[1:]]
    begins[edge] = letter[edge]
    own = np.flatnonzero(letter)
    starts = begins[own]
    out = np.zeros(len(own) + int(starts.sum()) + 1, dtype=np.uint64)
    spot = np.arange(len(own)) + np.cumsum(starts)
    out[spot] = point[own]
    # letters and starts before each document
    return out, sums(letter.astype(np.int64))[first] + sums(begins.astype(np.int64))[first]


def grams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of each length, with their documents; each document with a letter has some."""
    stream, first = letter_stream(column)
    size = np.diff(first)
    out = []
    for n in LENGTHS:
        number = np.where(size > 0, np.maximum(size + 2 - n, 0), 0)  # the blank after a document counts
        doc = np.repeat(np.arange(len(size)), number)
        place = np.arange(len(doc)) - np.repeat(sums(number)[:-1], number) + np.repeat(first[:-1], number)
        code = np.full(len(doc), n, dtype=np.uint64)
        for k in range(n):
            code += stream[place + k] * _FACTORS[k]
        out.append((mix(code), doc))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list] = {}

    def add(key: tuple[str, int], code: np.ndarray, n: np.ndarray) -> None:
        own = held.setdefault(key, [])
        own.append((code, n))
        if len(own) > 1 and sum(len(c) for c, _ in own) > 2_000_000:
            held[key] = [_gathered(own)]

    for batch in batches:
        for piece in pieces(batch, "_text"):
            langs = np.array(piece.column("_lang").to_pylist(), dtype=object)
            for length, (code, doc) in zip(LENGTHS, grams(piece.column("_text")), strict=True):
                for lang in dict.fromkeys(langs):
                    add((lang, length), *np.unique(code[(langs == lang)[doc]], return_counts=True))
    for (lang, length), own in held.items():
        code, n = _gathered(own)
        for start in range(0, len(code), 50_000):
            part = slice(start, start + 50_000)
            rows = len(code[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows), pa.array(np.full(rows, length, np.int32)), pa.array(code[part].view(np.int64)),
                 pa.array(n[part].astype(np.int64))],
                names=["lang", "length", "code", "n"],
            )


def _gathered(own: list) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own])
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[head], np.add.reduceat(n, head)


def slots(code: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram: disjoint parts of its hash, and of a second one."""
    again = mix(code ^ np.uint64(0xA0761D6478BD642F))
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [(x >> np.uint64(shift)) & mask for x in (code, again) for shift in (0, 32)][:HASHES]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = batch.column("code").to_numpy().view(np.uint64)
        bit = batch.column("bit").to_numpy().astype(np.int64)
        for slot in slots(code):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array((bit // 64).astype(np.int32)),
                 pa.array(np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64))],
                names=["slot", "word", "mask"],
            )


class Filters:
    """Slots of the bit-sliced filter, the languages of its bits, and each language's rate of false positives."""

    def __init__(self, langs: list[str], table: np.ndarray, most: int):
        self.langs, self.table, self.most = langs, table, most
        fill = [np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(table) for i in range(len(langs))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    def shares(self, column: pa.Array) -> np.ndarray:
        """Corrected share of the n-grams of each document that each language holds."""
        docs = len(column)
        hits = np.zeros((docs, len(self.langs)))
        total = np.zeros(docs)
        for code, doc in grams(column):
            total += np.bincount(doc, minlength=docs)
            places = slots(code)
            edges = np.searchsorted(doc, np.arange(docs + 1))
            for word in range(self.table.shape[1]):
                own = self.table[:, word]
                mask = own[places[0]]
                for p in places[1:]:
                    mask &= own[p]
                for i in range(word * 64, min(len(self.langs), word * 64 + 64)):
                    there = (mask >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.diff(sums(there.astype(np.int64))[edges])
        total = np.maximum(total, 1)[:, None]
        return np.clip((hits - total * self.false) / (total * (1 - self.false)), 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters learned from all given documents whose text and language are not null."""
    spark = tidy_arrow(docs.sparkSession)
    folder = scratch_folder(spark)
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counted = written(
        known.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
        .mapInArrow(_count, "lang string, length int, code long, n long")
        .groupBy("lang", "length", "code").agg(F.sum("n").alias("n")),
        folder, "counted",
    )
    totals = counted.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    names = [(r["lang"], r["total"]) for r in totals.groupBy("lang").agg(F.sum("total").alias("total")).orderBy("lang").toLocalIterator()]
    langs = [x for x, _ in names]
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    if langs:
        frequent = counted.join(F.broadcast(totals), ["lang", "length"]).withColumn("share", F.col("n") / F.col("total")).where(
            F.col("share") >= FLOOR
        )
        best = frequent.groupBy("code").agg(F.max("share").alias("best"))
        bits = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, bit int")
        chosen = frequent.join(best, "code").where(F.col("share") >= KEEN * F.col("best")).join(F.broadcast(bits), "lang")
        masks = chosen.select("code", "bit").mapInArrow(_slots, "slot int, word int, mask long").groupBy("slot", "word").agg(
            F.bit_or("mask").alias("mask")
        )
        # at most 2**21 rows for each 64 languages
        got = masks.toArrow()
        table[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    remove_folder(spark, folder)
    most = max(range(len(names)), key=lambda i: (names[i][1], -i)) if names else -1
    return Filters(langs, table, most)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with ``lang_pred`` and ``score``, one row for each input row.

    ``lang_pred`` is ``und`` for a null text, a text without letters, and where nothing was learned; equal shares go to the
    language that comes first by name, and a text whose n-grams no language holds to the language with most n-grams, with
    score 0.  ``score`` is the corrected share of the language.  Carried columns named like results are replaced.
    """
    spark = tidy_arrow(docs.sparkSession)
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    inner = [f"_c{i}" for i in range(len(carried))]
    read = docs.select(*(F.col(c).alias(x) for c, x in zip(carried, inner, strict=True)), F.col(text_col).alias("_text"))
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = piece.column("_text")
                stream_size = np.diff(letter_stream(texts)[1])
                if own.langs:
                    share = own.shares(texts)
                    best = share.argmax(axis=1)
                    score = share[np.arange(len(best)), best]
                    best = np.where(score > 0, best, own.most)
                    lang = np.array([*own.langs, UNKNOWN], dtype=object)[np.where(stream_size > 0, best, len(own.langs))]
                    score = np.where(stream_size > 0, score, 0.0)
                else:
                    lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in inner), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*inner, "lang_pred", "score"],
                )

    kinds = "".join(f"{x} {read.schema[x].dataType.simpleString()}, " for x in inner)
    out = read.mapInArrow(run, f"{kinds}lang_pred string, score double")
    return out.select(*(F.col(x).alias(c) for c, x in zip(carried, inner, strict=True)), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` of each document, learned from those that are not held out."""
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text0"), F.col(lang_col).alias("_lang0"),
                         held_out(id_col).alias("held_out"))
    filters = fit(marked.where(~F.col("held_out")), "_text0", "_lang0")
    out = predict(marked, filters, "_text0", ["_id", "held_out"])
    return out.withColumnRenamed("_id", id_col)
