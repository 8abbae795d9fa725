"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import shared_dir, table


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("piece", F.col("piece").cast("int"))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.topk import exact_topk, quantised

    rows = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    found = exact_topk(rows, rows.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.hpylm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The rules of the url query, fixed by contract: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.url_filter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark, "ledger"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.hard_negatives import hard_negatives, prepared

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", label, "embedding")
    return hard_negatives(rows, F.col("id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.alignment import align

    return align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_lm_scores": op2_lm_scores,
    "op3_pieces": op3_pieces,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op10_near_dedup": op10_near_dedup,
    "op6_token_files": op6_token_files,
    "op9_packing": op9_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}

def _secrets_sql() -> str:
    """Matches and the parts between them give every start; a match that fails its rule's condition is dropped."""
    from parlance.llm.secrets import BASE, RULES

    quoted = lambda s: s.replace("'", "''")
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, '{quoted(rule.pattern)}') AS m, regexp_extract_all(t, '{quoted(rule.pattern)}', {rule.least[0]}) AS g,
                string_split_regex(t, '{quoted(rule.pattern)}') AS p, {rule.least[1]} AS least FROM d WHERE regexp_matches(t, '{quoted(rule.hint)}')"""
        for k, rule in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
        f AS ({found}),
        s AS (SELECT r, k, kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, least FROM f),
        e AS (SELECT r, k, kind, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
              FROM s WHERE length(g[i]) >= least),
        o AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (kind IN ({base})) AS b, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
              FROM e GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)
    """


SQL: dict[str, str] = {
    "op11_secret_scan": _secrets_sql(),
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
}
