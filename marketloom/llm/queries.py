"""Queries of the training-text operators, each over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import leakage, neardup, packing, products, quantiles, residue, textstats
from marketloom.tables import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(load(spark, d, "redsky_pages")).select("page_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return products.same_product_pairs(load(spark, d, "deal_items"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return products.same_product_classes(load(spark, d, "deal_items")).select("item_id", "class_id")


def p6_days(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "deal_items").select("query", "total_price", F.to_date("received_at").alias("day"))
    return quantiles.part_and_total_percentiles(items, "query", "total_price", "day")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.select_percentiles(load(spark, d, "deal_items"), "query", "total_price")


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "deal_items").select("query", "total_price", F.to_date("received_at").alias("day"))
    return quantiles.combine(quantiles.part_summaries(items, "query", "total_price", "day"), "query")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(load(spark, d, "deal_items"))


def p7_edit_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.edit_classes(load(spark, d, "deal_items"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(load(spark, d, "documents"), load(spark, d, "context_sizes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(load(spark, d, "documents"), load(spark, d, "test_items"))


def p9_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(load(spark, d, "documents"), load(spark, d, "test_items"), tolerant=True)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    counts = textstats.document_counts(load(spark, d, "documents"), load(spark, d, "common_words"))
    return textstats.statistics(counts).where("not_prose").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return textstats.statistics(textstats.document_counts(load(spark, d, "documents"), load(spark, d, "common_words")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p5_found, p5_classes, p6_days, p6_percentiles, p6_combined, p7_found, p7_edit_classes, p8_packing, p9_found, p9_tolerant, p10_found, p10_statistics)}

#: Percentiles of summaries are exact, with a rank_error of 0, as long as a group has under 2,000 values (in sf0.01 the
#: largest has 267); beyond, they are within their rank_error, which tests assert.
SQL: dict[str, str] = {
    "p6_days": """
        WITH u AS (SELECT query, received_at::DATE AS day, total_price AS value FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price)),
        s AS (SELECT query, 'part' AS scope, day, value FROM u UNION ALL SELECT query, 'all', NULL, value FROM u),
        a AS (SELECT *, row_number() OVER (PARTITION BY query, scope, day ORDER BY value) AS k, count(*) OVER (PARTITION BY query, scope, day) AS n FROM s)
        SELECT query, scope, day, p.percentile::INTEGER AS percentile, n, value, 0::BIGINT AS rank_error
        FROM a JOIN (VALUES (50), (90), (95), (99)) p(percentile) ON k = greatest((n * p.percentile + 99) // 100, 1)""",
    "p6_combined": """
        WITH a AS (
          SELECT query, total_price AS value, row_number() OVER (PARTITION BY query ORDER BY total_price) AS k, count(*) OVER (PARTITION BY query) AS n
          FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price))
        SELECT query, p.percentile::INTEGER AS percentile, n, value, 0::BIGINT AS rank_error
        FROM a JOIN (VALUES (50), (90), (95), (99)) p(percentile) ON k = greatest((n * p.percentile + 99) // 100, 1)""",
    "p6_percentiles": """
        WITH a AS (
          SELECT query, total_price AS value, row_number() OVER (PARTITION BY query ORDER BY total_price) AS k, count(*) OVER (PARTITION BY query) AS n
          FROM deal_items WHERE total_price IS NOT NULL AND NOT isnan(total_price))
        SELECT query, p.percentile::INTEGER AS percentile, n, value, 0::BIGINT AS rank_error
        FROM a JOIN (VALUES (50), (90), (95), (99)) p(percentile) ON k = greatest((n * p.percentile + 99) // 100, 1)""",
}
