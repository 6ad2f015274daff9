"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import documents
from weftline.llm.fm_dedup import deduplicate_documents_by_words
from weftline.llm.fingerprints import fingerprint_documents
from weftline.llm.katz import score_corpus
from weftline.llm.language import identify_documents
from weftline.llm.mixing import mix_documents
from weftline.llm.near_dedup import near_duplicates
from weftline.llm.packing import pack_documents
from weftline.llm.sharding import shard_documents
from weftline.llm.suffix_dedup import deduplicate_documents
from weftline.llm.topk import search_embeddings

SHARDS = 8


def op1_score_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_documents(documents(spark, sf_dir), 200)


def op3_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_search_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words_per_shingle=2, percent=80)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_documents_by_words(documents(spark, sf_dir), 20)


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), SHARDS)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_score_katz": op1_score_katz,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_fingerprint_documents": op3_fingerprint_documents,
    "op4_mix_sources": op4_mix_sources,
    "op5_search_top_k": op5_search_top_k,
    "op6_identify_language": op6_identify_language,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_shard_documents": op9_shard_documents,
    "op10_pack_documents": op10_pack_documents,
}

ORACLES: dict[str, str] = {}

ORACLES["op4_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT) // 4 AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, coalesce(sum(3 * n) OVER b, 0) AS nb, coalesce(sum(w) OVER b, 0) AS wb, sum(n) OVER () AS tn, sum(w) OVER () AS tw
  FROM s WINDOW b AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (tn - nb) / (tw - wb) AS level FROM o WHERE (tn - nb) / (tw - wb) * w <= 3 * n ORDER BY 3 * n / w, nb LIMIT 1),
t AS (
  SELECT source, n, least(CAST(3 * n AS DOUBLE), level * w) AS target FROM s, l),
p AS (
  SELECT *, CASE WHEN n > 0 THEN least(floor(target / n), 3) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, CAST(p.n AS BIGINT) AS source_size, p.target, p.whole,
         p.target - p.whole * p.n AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(whole + CASE WHEN upto - size / 2 < budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r
"""

ORACLES["op5_search_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place AND len(q.v) = len(c.v)),
r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
