"""Queries p3, p7, p8 and p9 over the test tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.llm.leakage import find_passages
from quiver.llm.neighbours import nearest_pairs
from quiver.llm.repetition import document_statistics, repeated_documents
from quiver.llm.tokens import encode_documents

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: rows that the trees of p9 are fitted on, at any size of the input
FIT_ROWS = 4000
#: fixed values of p9: least share, least words, words of a window
LEAST_SHARE, LEAST_WORDS, WINDOW = 0.3, 20, 6


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 most similar of the other, at 0.9 or more."""
    near = nearest_pairs(spark.read.parquet(f"{sf}/vector_entry.parquet"))
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()


def p7_ids(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that reproduce passages of benchmark items."""
    found = find_passages(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select("doc_id", "item_id").distinct()


def p9_measured(spark: SparkSession, sf: str) -> DataFrame:
    """The number of words of every document and the share of them that is repeated."""
    measured = document_statistics(spark.read.parquet(f"{sf}/documents.parquet"), window=WINDOW)
    return measured.select("doc_id", F.col("words").cast("bigint").alias("words"), F.round("share", 6).alias("share"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with much repeated content: chosen by trees over cheap statistics, then counted exactly."""
    chosen = repeated_documents(spark.read.parquet(f"{sf}/documents.parquet"), share=LEAST_SHARE, words=LEAST_WORDS, window=WINDOW, rows=FIT_ROWS)
    return chosen.filter((F.col("share") >= LEAST_SHARE) & (F.col("words") >= LEAST_WORDS)).select("doc_id").distinct()


QUERIES = {"p3_found": p3_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_measured": p9_measured}

_WORDS = """
WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{L}+'), lambda x: lower(x)) AS ws FROM documents),
  g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, greatest(len(ws) - 4, 1))) AS i, ws FROM w),
  s AS (SELECT doc_id, n, i, array_to_string(ws[i : i + 5], ' ') AS six FROM g),
  r AS (SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, six ORDER BY i) AS rn FROM s) WHERE rn > 1),
  c AS (SELECT DISTINCT doc_id, n, i + k AS place FROM r, range(0, 6) t(k))"""

SQL = {
    "p9_found": f"{_WORDS} SELECT doc_id FROM c GROUP BY doc_id, n HAVING n >= 20 AND count(*) >= 0.3 * n",
    "p9_measured": f"{_WORDS}, m AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1) SELECT doc_id, CAST(len(ws) AS BIGINT) AS words, round(coalesce(k, 0) / greatest(len(ws), 1), 6) AS share FROM w LEFT JOIN m USING (doc_id)",
}
