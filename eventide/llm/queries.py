"""Registered queries of the training-data operators (name -> callable, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from eventide.llm import collocations, fingerprints, langid, licenses, mixing, near_dedup, negatives, packing, pii, quality, sharding, topk, warc
from eventide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_packing")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(packing.tokenize(docs, with_ids=False).drop("ids"), docs.count())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_mixing")
def op3(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query("op10_sharding")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    digests = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"),
                          F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    digests = digests.select("doc_id", "size", "text_crc32", F.xxhash64("text").alias("text_hash"))
    placed = sharding.shard(digests, group="text_hash", tie="doc_id", size="size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op5_topk", """
    WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
               FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op5(spark, sf_dir):
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


@query("op7_license_scan")
def op7(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_fingerprints")
def op8(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_warc", """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT payload_digest, max(page_id) AS response, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN n > 1 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n > 1 AND page_id <> response THEN response END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest)""")
def op6(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_quality")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op9_pii")
def op9(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS[:pii.BASE]], F.sha2(pii.printed("base"), 256).alias("base_sha256"), pii.printed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"))


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@query("op12_hard_negatives", """
    WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                      [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                 CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op12(spark, sf_dir):
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    rows = negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)))
    return negatives.mine(rows, rows.where(F.col("id") % 50 == 0))


@query("op13_collocations", r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                    FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
    phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM places, (VALUES (1), (2), (3), (4)) s(k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k, p, string_split(p, ' ') AS w, f FROM (SELECT lang, k, p, count(*) AS f FROM phrases GROUP BY lang, k, p HAVING count(*) >= 30)),
    cuts AS (SELECT lang, p, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
             FROM f, (VALUES (1), (2), (3)) s(c) WHERE c < k),
    scored AS (SELECT c.lang, c.p, c.a, c.c, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
               FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.head JOIN f r ON r.lang = c.lang AND r.p = c.tail
               QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, c.c) = 1),
    subs AS (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM f, (VALUES (2), (3)) s(m) WHERE m < k),
    covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(f) AS cover FROM subs GROUP BY 1, 2),
    kept AS (SELECT s.* FROM scored s LEFT JOIN covers c ON c.lang = s.lang AND c.p = s.p WHERE cover IS NULL OR 100 * cover < 80 * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
    SELECT lang, rank, p AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
