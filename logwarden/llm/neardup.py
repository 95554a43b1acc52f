"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

* A shingle is five words (all words of a shorter text).  Its weight is its count in the text times the mean inverse
  document frequency of its words.  Document frequencies are counted over all documents; a word in fewer than ``RARE`` of
  them has the largest weight, so the words whose frequency has to be known are at most ``1 / RARE`` times as many as the
  mean document has different words.  That bounds the table that executors get.  Taking the frequency of words and not
  of whole shingles keeps a group of thousands of copies from devaluing what its members share.
* Each of 39 consistent weighted samples picks a shingle and a level; two texts pick the same with the probability of
  their weighted Jaccard similarity.  Thirteen bands of three samples make candidates: a pair at 0.8 is missed with
  probability 0.0001, at 0.9 with less than 1e-7.
* What can be shared bounds what is similar: of a candidate's weight, only the shingles that also occur in another
  candidate count.  A pair whose similarity cannot reach 0.8 by this bound is no pair, and that is exact.  It settles most
  members of a large group of edited copies without comparing them.
* A bucket first compares every member with the one whose weight is shared most (in a group of edited copies, the
  original).  Where all members are then in one component nothing can be missing; elsewhere the members of different
  components are compared too, as far as the bound allows, so no link between candidates is lost, and a large group of
  copies costs one comparison for each member.
* Every link is verified: exact weighted Jaccard similarity of the whole texts, in whole numbers.  Exact copies share
  one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import keyed, pieces, remove_folder, scratch_folder, tidy_arrow, written
from logwarden.llm.components import components
from logwarden.llm.substrings import repeated_windows
from logwarden.llm.words import Words, mix, powers, rolling, split_words, sums, window_hashes, window_starts, word_hashes

SHINGLE = 5
BANDS, ROWS = 13, 3
SAMPLES = BANDS * ROWS
RARE = 1e-3
#: Inverse document frequencies are whole multiples of 1/64, so that weights add up exactly.
UNIT = 64
#: Candidates agree in at least this many of 40 signature bytes (the last always agrees); a pair at 0.8 fails with 2e-4.
AGREE = 23
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        code, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[head], np.add.reduceat(n, head)

    for batch in batches:
        for piece in pieces(batch, "_text"):
            w = split_words(piece.column("_text"))
            if not len(w.start):
                continue
            code = word_hashes(w)
            order = np.argsort(code, kind="stable")
            code, doc = code[order], w.doc[order]
            new = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
            held.append(np.unique(code[new], return_counts=True))
            if sum(len(x) for x, _ in held) > 2_000_000 and len(held) > 1:
                held = [gathered()]
    if held:
        code, n = gathered()
        for start in range(0, len(code), 50_000):
            part = slice(start, start + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=["word", "n"]
            )


class Weights:
    """Inverse document frequencies of the words that are not rare, sorted by hash; all others have the largest."""

    def __init__(self, words: np.ndarray, n: np.ndarray, docs: int):
        order = np.argsort(words)
        self.words = words[order]
        self.idf = np.rint(UNIT * (1 - np.log(n[order] / max(docs, 1)))).astype(np.int64)
        self.rare = int(np.rint(UNIT * (1 - np.log(RARE))))

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(codes), self.rare, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[place] == codes, self.idf[place], self.rare)


def fit(texts: DataFrame) -> Weights:
    """Weights of words from ``_text`` of all rows."""
    docs = texts.count()
    common = (
        texts.select("_text").mapInArrow(_document_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        .where(F.col("n") > RARE * docs)
    ).toArrow()
    return Weights(common["word"].to_numpy().view(np.uint64), common["n"].to_numpy().astype(np.float64), docs)


def occurrences(w: Words, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every shingle where it stands: document, first word, hash and weight of one occurrence (a whole number)."""
    codes = word_hashes(w)
    idf = sums(weights.of(codes))
    count = w.count
    starts = window_starts(w, SHINGLE)
    whole = np.flatnonzero((count > 0) & (count < SHINGLE))
    begin = np.concatenate((starts, w.first[whole]))
    size = np.concatenate((np.full(len(starts), SHINGLE), count[whole]))
    hashes = np.concatenate((window_hashes(codes, starts, SHINGLE), window_hashes(codes, w.first[whole], count[whole])))
    hashes ^= mix(size.astype(np.uint64))
    # a mean of idfs times 60, the least common multiple of 1 to 5, stays whole
    return w.doc[begin], begin, hashes, (idf[begin + size] - idf[begin]) * (60 // size)


def shingles(w: Words, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each document: document, hash and weight (times its count), by document and hash."""
    doc, _, hashes, weight = occurrences(w, weights)
    order = np.lexsort((hashes, doc))
    doc, hashes, weight = doc[order], hashes[order], weight[order]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))) if len(doc) else np.zeros(0, int)
    tf = np.diff(np.append(head, len(doc)))
    return doc[head], hashes[head], weight[head] * tf


def _shared(weights):
    """Of each candidate's weight, what lies in shingles that occur twice among the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                w = split_words(piece.column("_text"))
                doc, begin, _, weight = occurrences(w, weights.value)
                again = np.zeros(len(w.start) + 1, dtype=bool)
                for i, found in enumerate(piece.column("_starts").to_pylist()):
                    again[w.first[i] + np.frombuffer(found or b"", np.uint32).astype(np.int64)] = bool(found)
                again = again[begin] | (w.count[doc] < SHINGLE)
                part = np.bincount(doc[again], weights=weight[again], minlength=piece.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(part)], names=["node", "shared"])

    return run


def samples(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Consistent weighted samples of each document, as ``SAMPLES`` rows of 64-bit names; 0 where it has no shingle."""
    out = np.zeros((SAMPLES, docs), dtype=np.uint64)
    if not len(doc):
        return out
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(head, len(doc)))
    log_weight = np.log(weight.astype(np.float64) / (60 * UNIT))
    for k in range(SAMPLES):
        seed = int(powers(0x9E3779B97F4A7C15, k + 2)[0][k + 1])
        z = mix(hashes ^ np.uint64(seed))
        r = -np.log(((z >> np.uint64(43)) + 0.5) * 2.0**-21 * (((z >> np.uint64(22)) & np.uint64(0x1FFFFF)) + 0.5) * 2.0**-21)
        beta = (z & np.uint64(0x3FFFFF)) * 2.0**-22
        z = mix(z ^ np.uint64(0x2545F4914F6CDD1D))
        log_c = np.log(-np.log(((z >> np.uint64(32)) + 0.5) * 2.0**-32 * ((z & np.uint64(0xFFFFFFFF)) + 0.5) * 2.0**-32))
        level = np.floor(log_weight / r + beta)
        log_a = log_c - r * (level - beta) - r
        least = np.repeat(np.minimum.reduceat(log_a, head), size)
        at = np.flatnonzero(log_a == least)[::-1]
        chosen = np.zeros(docs, dtype=np.int64)
        chosen[doc[at]] = at  # the first of equal ones stays
        own = doc[head]
        pick = chosen[own]
        out[k, own] = mix(hashes[pick] ^ mix(level[pick].astype(np.int64).view(np.uint64)))
    return out


def _signatures(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                docs = piece.num_rows
                doc, hashes, weight = shingles(split_words(piece.column("_text")), weights.value)
                picked = samples(doc, hashes, weight, docs)
                total = np.bincount(doc, weights=weight, minlength=docs).astype(np.int64)
                own = np.flatnonzero(total)
                bands = np.empty((BANDS, docs), dtype=np.uint64)
                for b in range(BANDS):
                    key = np.full(docs, b + 1, dtype=np.uint64)
                    for row in picked[b * ROWS : (b + 1) * ROWS]:
                        key = mix(key ^ row)
                    bands[b] = key
                marks = np.zeros((docs, 40), dtype=np.uint8)
                marks[:, :SAMPLES] = (picked & np.uint64(0xFF)).astype(np.uint8).T
                lists = [marks.view(np.int64)[own], bands.T.view(np.int64)[own]]
                keys = [piece.column(c).take(pa.array(own)) for c in ("_k1", "_k2")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(total[own]),
                     *(pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel())) for x in lists)],
                    names=["_k1", "_k2", "weight", "marks", "bands"],
                )

    return run


def similar_enough(a: pa.Array, b: pa.Array, weights: Weights, tenths: int = 8) -> np.ndarray:
    """Whether the weighted Jaccard similarity of each pair of texts is at least ``tenths`` / 10, exactly."""
    (da, ha, wa), (db, hb, wb) = (shingles(split_words(x), weights) for x in (a, b))
    doc, hashes, weight = np.concatenate((da, db)), np.concatenate((ha, hb)), np.concatenate((wa, wb))
    order = np.lexsort((hashes, doc))
    doc, hashes, weight = doc[order], hashes[order], weight[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    n = len(a)
    shared = np.zeros(n, dtype=np.int64)
    np.add.at(shared, doc[both], np.minimum(weight[both], weight[both + 1]))
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, doc, weight)
    return (shared > 0) & (10 * shared >= tenths * (total - shared))


def _verify(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                good = similar_enough(piece.column("ta"), piece.column("_text"), weights.value)
                yield piece.select(["u", "v"]).filter(pa.array(good))

    return run


def _alike(a: str, b: str) -> Column:
    """Whether enough of the signature bytes agree and the weight that a pair can share allows a similarity of 0.8."""
    agree: Column = F.lit(0)
    for i in range(5):
        x = F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])
        for shift in (4, 2, 1):  # now the lowest bit of a byte tells whether any bit of it was set
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        agree = agree + (8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    most = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return (most * 10 >= (F.col(f"{a}.weight") + F.col(f"{b}.weight") - most) * 8) & (agree >= AGREE)


def _links(pairs: DataFrame, signs: DataFrame, texts: DataFrame, weights, folder: str, name: str) -> DataFrame:
    """Those of the pairs ``u, v`` that are similar, as a table."""
    likely = pairs.join(signs.alias("a"), F.col("u") == F.col("a.node")).join(signs.alias("b"), F.col("v") == F.col("b.node")).where(
        _alike("a", "b")
    ).select("u", "v")
    likely = written(likely, folder, f"{name}-likely")
    full = likely.join(texts.select(F.col("node").alias("v"), "_text"), "v").join(
        texts.select(F.col("node").alias("u"), F.col("_text").alias("ta")), "u"
    ).select("u", "v", "ta", "_text")
    kind = full.schema["u"].dataType.simpleString()
    return written(full.mapInArrow(_verify(weights), f"u {kind}, v {kind}"), folder, f"{name}-links")


def _node() -> Column:
    return F.struct("_k1", "_k2")


def labels(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``node, label`` of all texts in a class of more than one text; a node is the key of a text, copies included."""
    spark = tidy_arrow(docs.sparkSession)
    folder = scratch_folder(spark)
    texts = keyed(docs.select(F.col(text_col).alias("_text")), "_text").withColumn("node", _node())
    weights = spark.sparkContext.broadcast(fit(texts))
    signs = (
        texts.select("_k1", "_k2", "_text")
        .mapInArrow(_signatures(weights), "_k1 long, _k2 long, weight long, marks array<long>, bands array<long>")
        .groupBy("_k1", "_k2").agg(F.first("weight").alias("weight"), F.first("marks").alias("marks"), F.first("bands").alias("bands"))
        .select(_node().alias("node"), "weight", "marks", "bands")
    )
    signs = written(signs, folder, "signatures")
    members = signs.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most")
    members = written(members.join(buckets.select("key"), "key"), folder, "members")
    # one text for each candidate
    there = texts.join(members.select("node").distinct(), "node", "left_semi").groupBy("_k1", "_k2").agg(F.min("_text").alias("_text"))
    there = written(there.withColumn("node", _node()), folder, "texts")
    again = there.join(repeated_windows(there, SHINGLE), ["_k1", "_k2"], "left").select("node", "_text", "_starts")
    kind = there.schema["node"].dataType.simpleString()
    shared = again.mapInArrow(_shared(weights), f"node {kind}, shared long")
    # no partner can share more than all of it
    brief = written(
        signs.select("node", "weight", "marks").join(shared, "node").where("10 * shared >= 8 * weight"), folder, "brief"
    )
    members = written(members.join(brief.select("node", (F.col("shared") / F.col("weight")).alias("part")), "node"), folder, "able")
    best = members.groupBy("key").agg(F.max_by("node", F.struct("part", "node")).alias("best"), F.count("*").alias("n")).where("n > 1")
    members = written(members.join(best.select("key", "best"), "key").select("key", "node", "best"), folder, "bucketed")
    stars = members.where("node != best").select(F.col("best").alias("u"), F.col("node").alias("v")).distinct()
    links = _links(stars, brief, there, weights, folder, "star")
    first = components(links, folder, "first")
    # buckets whose members are not all connected yet: members of different components are candidates too
    labelled = written(
        members.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")),
        folder, "labelled",
    )
    share = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = share.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("k")).where("k > 1")
    # a similarity of 0.8 allows total weights one step of 1.25 apart
    step = F.floor(F.log("weight") / F.log(F.lit(1.25))).cast("int")
    rest = labelled.join(open_.select("key", "main"), "key").join(brief, "node").join(signs.select("node", "bands"), "node").withColumns(
        {"step": step, "minor": F.col("label") != F.col("main")}
    )
    minor = rest.where("minor").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    # a pair is looked at in the first bucket that it shares, and from one side
    earlier = F.arrays_overlap(*(F.expr(f"slice({x}.bands, 1, cast(array_position({x}.bands, key) - 1 AS int))") for x in "ab"))
    once = ~earlier & (~F.col("b.minor") | (F.col("a.node") < F.col("b.node")))
    cross = minor.alias("a").join(rest.alias("b"), ["key", "step"]).where(
        (F.col("a.label") != F.col("b.label")) & _alike("a", "b") & once
    ).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    more = _links(cross, brief, there, weights, folder, "cross")
    out = written(components(links.union(more), folder, "last"), scratch_folder(spark), "labels")
    remove_folder(spark, folder)  # nothing that follows reads the tables on the way
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``class_id`` of each row: rows with equal ``class_id`` are copies or near copies.

    Links are pairs of texts whose weighted Jaccard similarity is 0.8 or more; classes are the components of links, named
    by their smallest id (null where all ids are null).  A text of one to four words is one shingle.  A null text or one
    without words has no shingles and is a class of its own, under its own id.  Repeated rows are copies.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = labels(docs, "_text")
    rows = keyed(docs, "_text").select("_id", _node().alias("node"), F.coalesce(F.col("_text").rlike(HAS_WORD), F.lit(False)).alias("spoken"))
    named = rows.where("spoken").join(found, "node", "left").select("_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("_id").alias("class_id"))
    return named.join(least, "label").select(F.col("_id").alias(id_col), "class_id").union(
        rows.where("NOT spoken").select(F.col("_id").alias(id_col), F.col("_id").alias("class_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each class the row with the smallest id stays (once)."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    ids, text = (F.col(own[docs.columns.index(c)]) for c in (id_col, text_col))
    plain = docs.toDF(*own)
    found = labels(docs, text_col)
    spoken = F.coalesce(text.rlike(HAS_WORD), F.lit(False))
    rows = keyed(plain, *own).withColumn("row", _node())
    nodes = keyed(plain.withColumn("_text", text), "_text").withColumn("node", _node())
    narrow = keyed(nodes, *own).where(spoken).select("node", _node().alias("row"), ids.alias("_id"))
    chosen = narrow.join(found, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(
        F.min_by("row", F.struct(F.col("_id").isNull(), "_id", "row")).alias("row")
    )
    kept = rows.where(spoken).join(chosen.select("row"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*own).union(plain.where(~spoken)).toDF(*docs.columns)
