"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.llm import (
    decontaminate, exact_dedup, html_extract, jaccard_join, licenses, line_dedup, mixing, periodic_runs,
    sharding, substring, topk, toxicity, whitening,
)
from linewell.llm._common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.allocate(table(spark, sf_dir, "documents"))
    repeated = decided.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return repeated.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "group_id", "n_links")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), n_shards=24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.with_kept_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select(
        F.col("row")["doc_id"].alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", _scaled(F.col("embedding")).alias("x"))
    white = whitening.whiten(vectors, "vec_id", "x", components=8)
    return white.select(
        F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", "explained", "identity_error")


def _scaled(vector: Column) -> Column:
    """Entries as whole numbers, floor(1024 * c) + 100000; null for a vector that takes no part."""
    wrong = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~wrong, F.transform(vector, lambda c: F.try_add(F.floor(c.cast("double") * 1024), F.lit(100000))))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(table(spark, sf_dir, "documents"), rewrite=_echoed)
    best = periodic_runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _echoed(doc_id: int | None, n: int) -> np.ndarray | None:
    """In a tenth of the texts, chosen by a checksum of the id, the words of an end repeat with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_top_k": op6_top_k,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Stripped at both ends of a line: chr(32) and chr(9) to chr(13).
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op6_top_k": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        pairs AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.n <> q.n),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS r FROM pairs)
        SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op8_line_dedup": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
            FROM documents),
        lines AS (
            SELECT r, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM docs),
        keyed AS (
            SELECT r, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), {_BLANKS}) AS key FROM lines),
        common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
        kept AS (
            SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
                   coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '') AS kept
            FROM keyed LEFT JOIN common c ON keyed.key = c.key GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN docs USING (r)""",
    "op12_exact_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS k
            FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r))
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g""",
}
