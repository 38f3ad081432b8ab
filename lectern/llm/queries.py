"""Queries of this subpackage, with production parameters over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    bit_slices, edit_prints, hard_negatives, language, mixing, near_dups, packing, pivots, sharding, substrings, tokens, toxicity, warc,
)
from lectern.llm.common import table


def op1_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (markup language, address) together."""
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = language.fit_text_model(documents, "text", "lang", max_rows=20_000)
    rows = documents.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")
    ).unionByName(
        pages.withColumns(language.page_evidence(F.col("html"), F.col("url"))).select(
            F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "host"
        )
    )
    return language.identified(rows, model, ["doc_id", "page_id"], "text", "declared", "host")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, folder, "documents"), weights=(5, 2, 1), most=3.0, share=1.0)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    vocabulary, ranks = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.packed_documents(docs, vocabulary, ranks, capacity=1024, end_id=2)


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~toxicity.held_out())
    model = toxicity.fit(documents, labels, most=2000)
    return toxicity.toxicity(documents, model, threshold=0.7).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted"
    )


def op6_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_prints.with_edits_and_classes(table(spark, folder, "documents"))


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs)


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return bit_slices.top_inner_products(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"), least_bytes=0)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_shards(spark: SparkSession, folder: str) -> DataFrame:
    """By bytes; equal texts share a shard unless none has room for them all."""
    plan = sharding.plan_shards(table(spark, folder, "documents"), shards=16)
    return sharding.placements(plan).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.clusters(table(spark, folder, "embeddings"), k=40, rounds=5, scale=256, width=64, seed="2")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(
        vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_languages": op1_languages,
    "op2_mix_sources": op2_mix_sources,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_edit_fingerprints": op6_edit_fingerprints,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_shards": op11_shards,
    "op12_clusters": op12_clusters,
    "op13_hard_negatives": op13_hard_negatives,
}


def _clusters_sql(k: int, rounds: int) -> str:
    """k-means with every distance computed, a round after the other."""
    parts = [f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {k}
        )"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, (d, c)) AS c
            FROM (SELECT r, vec_id, kept.v AS v, c, list_inner_product(kept.v, kept.v)
                         - 2 * list_inner_product(kept.v, c{i}.v) + list_inner_product(c{i}.v, c{i}.v) AS d
                  FROM kept CROSS JOIN c{i})
            GROUP BY r
        )""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
                SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
                    SELECT c, list(floor(s / n) ORDER BY place) AS v
                    FROM (SELECT c, place, sum(x) AS s, count(*) AS n
                          FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY c, place)
                    GROUP BY c
                ) m USING (c)
            )""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c{rounds}.v], ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""


#: SQL twins of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op8_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 10
    """,
    "op9_warc": """
        WITH hashed AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), told AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
                   array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)
                       FOR i IN range(32)], '') AS payload_digest,
                   max(page_id) OVER (PARTITION BY payload) AS largest
            FROM hashed
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM told
    """,
    "op12_clusters": _clusters_sql(40, 5),
    "op13_hard_negatives": """
        WITH kept AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM kept a JOIN kept c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
        ), positive AS (
            SELECT * FROM scored WHERE own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.own
             AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER best <= 10
    """,
}
