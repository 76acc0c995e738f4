"""The registered queries of the operators over documents, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm import (
    divergence,
    encoding,
    exact,
    filters,
    latent,
    licenses,
    nearest,
    packing,
    passages,
    quality,
    simhash,
    token_files,
    tokens,
    toxicity,
)
from postroom.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), encoding.vocabulary(BYTE_BPE))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), encoding.vocabulary(BYTE_BPE))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.removed_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), encoding.vocabulary(BYTE_BPE))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.benchmark_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_interactions(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op3_toxicity": op3_toxicity,
        "op2_token_counts": op2_token_counts,
        "op4_simhash": op4_simhash,
        "op5_token_files": op5_token_files,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_licenses": op7_licenses,
        "op8_packing": op8_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_nearest": op11_nearest,
        "op12_source_divergence": op12_source_divergence,
        "op13_filter_interactions": op13_filter_interactions,
    }


def all_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            WITH d AS (
              SELECT doc_id,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
              FROM documents
            )
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY content)
        """,
        "op11_nearest": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
            )
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
              vec_id, score
            FROM s QUALIFY rank <= 20
        """,
        "op12_source_divergence": """
            WITH d AS (
              SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
              FROM documents
            ), words AS (
              SELECT r, lang, source,
                unnest(regexp_extract_all(content, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
              FROM d
            ), kept AS (
              SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30
            ), counts AS (
              SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
            ), langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang
            ), groups AS (
              SELECT lang, source, coalesce(v, 0) AS v, coalesce(whole, 0) AS whole, coalesce(sum(n), 0) AS mine
              FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang)
              LEFT JOIN counts USING (lang, source) GROUP BY ALL
            ), cells AS (
              SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (mine + 5 * v)::HUGEINT)::BIGINT AS p,
                (1 + (1000000000::HUGEINT * (total + 5)) // (whole + 5 * v)::HUGEINT)::BIGINT AS q
              FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)
            ), apart AS (
              SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
              FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            ), every AS (
              SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
            )
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM every QUALIFY part = 'pair' OR rank <= 50
        """,
        "op13_filter_interactions": """
            WITH d AS (
              SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS content FROM documents
            ), marked AS (
              SELECT doc_id, part, content, regexp_extract_all(content, '[^ \\x09-\\x0D]+') AS words,
                length(content) AS points, min(doc_id) OVER (PARTITION BY content) AS first
              FROM d
            ), fails AS (
              SELECT doc_id, part, [
                len(words) < 200,
                100 * len(list_distinct(words)) < 50 * len(words),
                100 * length(regexp_replace(content, '[^A-Z]', '', 'g')) > 3 * points,
                regexp_matches(content, '[#$%&*|]'),
                coalesce(doc_id > first, false)
              ] AS f
              FROM marked
            ), judged AS (
              SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM fails LEFT JOIN (
                SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
              ) USING (doc_id)
            ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
            ), orders AS (
              SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
              FROM letters a, letters b, letters c, letters d, letters e
              WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
            ), steps AS (
              SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS l,
                list_transform(string_split(filter_order, '')[1:step - 1], lambda x: ascii(x) - 64) AS before,
                ascii(l) - 64 AS place
              FROM orders, range(1, 6) t(step)
            ), sets AS (
              SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
              FROM judged GROUP BY ALL
            ), applied AS (
              SELECT *, f[place] AS failing, len(list_filter(before, lambda i: f[i])) > 0 AS gone FROM sets, steps
            ), counted AS (
              SELECT part, filter_order, step, l,
                coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (WHERE failing AND gone), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (WHERE failing AND len(list_filter(f, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (WHERE failing AND NOT gone), 0)::BIGINT AS toxic_lost
              FROM applied GROUP BY ALL
            )
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
              sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley
            FROM counted
        """,
    }
