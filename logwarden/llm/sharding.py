"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash, whose oversized buckets split on.

A row belongs to the bucket of the shortest prefix of its hash whose rows together fit the byte limit.  Only that has to
be found, so Spark adds up the bytes of fine cells of the hash space once, adds the cells up again for every shorter
prefix, and counts for each cell how many of its prefixes are too large: that is the depth of its bucket.  Cells that are
too large themselves are cut finer, alone, until they fit or hold one hash only.

The hash is the MD5 of id and text, so rows that share an id spread.  Rows that are equal in both cannot be told apart by
any hash; a bucket of such rows that is too large is cut into numbered parts by counting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import scratch_folder, written

LIMIT = 1 << 20
#: Bits of a hash that the directory can use: fifteen hexadecimal digits.
HASH_BITS = 60
#: Bits by which cells are finer than shards of the mean size.
FINER = 5


def row_hash(ids: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text, as a number; nulls have hashes of their own."""
    both = F.concat(F.coalesce(ids.cast("string"), F.lit("\u0001")), F.lit("\n"), F.coalesce(text, F.lit("\u0001")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_key(ids: Column, text: Column) -> Column:
    """What tells rows apart: SHA-256 of id and text with their lengths; nulls differ from all texts."""
    def part(x: Column) -> Column:
        return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))

    return F.sha2(F.concat(part(ids.cast("string")), F.lit("\n"), part(text)).cast("binary"), 256)


def leading(hashes: Column, of: int, bits: Column) -> Column:
    """The first ``bits`` bits of hashes that have ``of`` bits."""
    return F.call_function("shiftright", hashes, (F.lit(of) - bits).cast("int"))


def _split(work: DataFrame, base: int, bits: int, limit: int, folder: str) -> DataFrame:
    """``cell, depth, again`` for cells of ``bits`` bits, all of whose prefixes shorter than ``base`` bits are too large."""
    cells = written(
        work.groupBy("cell").agg(F.sum("n_bytes").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")),
        folder, f"cells-{bits}",
    )
    every = cells.select("cell", "n", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("d")).withColumn(
        "p", leading(F.col("cell"), bits, F.col("d"))
    )
    large = every.groupBy("d", "p").agg(F.sum("n").alias("bytes")).where(F.col("bytes") > limit).select("d", "p")
    depths = every.join(large, ["d", "p"]).groupBy("cell").agg((F.lit(base) + F.count("*")).cast("int").alias("depth"))
    found = cells.join(depths, "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(base)))
    over = F.col("depth") > bits
    again = over & (F.col("low") != F.col("high"))
    # a cell of one hash that is too large is a bucket of the whole hash
    return written(
        found.select("cell", F.when(over, HASH_BITS).otherwise(F.col("depth")).alias("depth"), again.alias("again"), over.alias("over")),
        folder, f"depths-{bits}",
    )


def assign(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (with ``hash`` and ``n_bytes``) with ``depth`` and ``over``: the bits of their bucket's prefix, and whether it
    is one hash whose rows do not fit the limit."""
    folder = scratch_folder(rows.sparkSession)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + FINER))
    base, work, out = 0, rows, None
    while True:
        work = work.withColumn("cell", leading(F.col("hash"), HASH_BITS, F.lit(bits)))
        cells = _split(work, base, bits, limit, folder)
        settled = work.join(cells.where("NOT again").select("cell", "depth", "over"), "cell").drop("cell")
        out = settled if out is None else out.unionByName(settled)
        if bits == HASH_BITS or cells.where("again").isEmpty():
            return out
        work = work.join(cells.where("again").select("cell"), "cell", "left_semi").drop("cell")
        base, bits = bits + 1, min(HASH_BITS, bits + FINER + 3)


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """``_id, n_bytes, shard, depth, part`` of each row, and ``_key`` (:func:`row_key`) where ``whole`` asks for it."""
    key = ["_key"] if whole else []
    rows = docs.select(F.col(id_col).alias("_id"), row_hash(F.col(id_col), F.col(text_col)).alias("hash"),
                       *(row_key(F.col(id_col), F.col(text_col)).alias(k) for k in key),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    # equal rows travel as one with a count
    equal = rows.groupBy("_id", "hash", *key, F.col("n_bytes").alias("size")).agg(F.count("*").alias("times"))
    placed = assign(equal.withColumn("n_bytes", F.col("size") * F.col("times")), limit)
    many = F.greatest(F.floor(F.lit(limit) / F.greatest("size", F.lit(1))), F.lit(1))
    placed = placed.withColumn("per", F.when(F.col("over"), many).otherwise(F.col("times")).cast("long"))
    last = F.floor((F.col("times") - 1) / F.col("per")).cast("long")
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    bits = F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), HASH_BITS, "0")
    name = F.when(F.col("depth") == 0, F.lit("all")).otherwise(F.substring(bits, F.lit(1), F.col("depth")))
    name = F.when(F.col("over"), F.concat(name, F.lit("."), F.col("part").cast("string"))).otherwise(name)
    here = F.least(F.col("per"), F.col("times") - F.col("part") * F.col("per"))
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), here))).select(
        "_id", *key, F.col("size").alias("n_bytes"), name.alias("shard"), F.col("depth").cast("long").alias("depth"), "part"
    )


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, shard, depth, part`` of each row: the rows of a shard have at most ``limit`` bytes of text.

    ``shard`` is the bucket's prefix in binary (``all`` for a directory of one bucket), followed by a dot and the part if
    rows that are equal in id and text had to be divided.  A text that is longer than the limit is alone in its part.
    Null ids and texts have hashes of their own, a null or empty text has no bytes, repeated rows count as often as they
    occur, and other columns are not read.
    """
    return _placed(docs, limit, id_col, text_col).select(F.col("_id").alias(id_col), "n_bytes", "shard", "depth", "part")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write id and text of every row below ``path``, one folder ``shard=...`` for each shard."""
    placed = _placed(docs, limit, id_col, text_col, whole=True)
    # Hashes of 60 bits can be equal by chance, so rows meet their shards by the whole text: id, full digest and length.
    # Equal rows are told apart by a number only, so one of them serves all.
    whole = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", row_key(F.col("_id"), F.col("_text")))
    texts = whole.dropDuplicates(["_key"])
    out = placed.join(texts.drop("_id"), "_key").select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "shard")
    out.repartition("shard").write.partitionBy("shard").parquet(path)
