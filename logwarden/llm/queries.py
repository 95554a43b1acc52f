"""The thin queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import (
    collocations,
    langid,
    neardup,
    negatives,
    neighbours,
    packing,
    pieces,
    private,
    quality,
    sharding,
    substrings,
    toxicity,
    warc,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_substring_dedup", r"""
WITH w AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
    SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
    SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM rep) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
    sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ')
        ELSE coalesce(array_to_string([ws[k] FOR k IN range(1, len(ws) + 1) IF NOT list_contains(ks, k)], ' '), '') END)
        AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""")
def op10_substring_dedup(spark, sf_dir):
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_minhash_neardup")
def op5_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_warc", r"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN NULL ELSE last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""")
def op7_warc(spark, sf_dir):
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), spans=False)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_extendible_sharding", f"""
WITH d AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(1)) || chr(10) || coalesce(text, chr(1))), 1, 15))::BIGINT AS h
    FROM documents
), large AS (
    SELECT b, h >> (60 - b) AS p FROM (SELECT h, n_bytes, unnest(range(0, 61))::INT AS b FROM d)
    GROUP BY ALL HAVING sum(n_bytes) > {sharding.LIMIT}
), deep AS (
    SELECT d.doc_id, d.n_bytes, d.h, count(l.b) AS k, row_number() OVER (PARTITION BY d.h) - 1 AS i
    FROM (SELECT *, row_number() OVER () AS r FROM d) d LEFT JOIN large l ON d.h >> (60 - l.b) = l.p
    GROUP BY d.r, d.doc_id, d.n_bytes, d.h
), named AS (
    SELECT *, least(k, 60)::BIGINT AS depth,
        CASE WHEN k > 60 THEN i // greatest({sharding.LIMIT} // greatest(n_bytes, 1), 1) ELSE 0 END::BIGINT AS part
    FROM deep
)
SELECT doc_id, n_bytes, depth, part,
    CASE WHEN depth = 0 THEN 'all' ELSE lpad(bin(h >> (60 - depth)::INT), depth::INT, '0') END
        || CASE WHEN k > 60 THEN '.' || part ELSE '' END AS shard
FROM named""")
def op8_extendible_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.predict(docs, toxicity.fit(docs, labels, ["low_quality", "toxic"]))


@query("op3_nn_descent")
def op3_nn_descent(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op13_collocations", r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
    SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, unnest(range(1, 6)) AS k FROM words) WHERE len(ws) >= k)
), f AS (SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL),
size AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100),
inner_phrases AS (
    SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
    GROUP BY ALL
), kept AS (
    SELECT c.* FROM c LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, cut, x.n AS l, y.n AS r, size.n,
        (1000::HUGEINT * a * size.n // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
    JOIN size ON size.lang = cuts.lang
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000""")
def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents")).drop("cut")


@query("op12_hard_negatives", """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        coalesce(list_sum([coalesce(a.v[i], 0) * coalesce(b.v[i], 0) FOR i IN range(1, len(a.v) + 1)]), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
    other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op11_private_data")
def op11_private_data(spark, sf_dir):
    found = private.find(table(spark, sf_dir, "documents"))
    counts = [F.size(private.of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in private.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(private.shown(F.col("base")), 256).alias("base_sha256"),
        private.shown(private.merged(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
